"""Assets and native keys: identity, reconciliation with a provider's listing, manual admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fill_tag, slug
from ..session import cut_lineage
from ..schema import DEFAULT_SERVICE, NATIVE_KEYS, PROVIDER_PREFIX, TAG_ATTRIBUTE, UNRESOLVED

ABSENCES_TO_RETIRE = 3  # fixed value


def resolve(df: DataFrame, keys: DataFrame, attrs: str = "attrs", default_service: str = DEFAULT_SERVICE) -> DataFrame:
    """J1 + P5: the six tags of a resource, ``orphan``, and the key that was used.

    The first native key that the catalogue knows decides; when none does, the
    first one that is present is reported. Resources repeat: their distinct key
    values are looked up in one join, and the hits go back to the rows by
    resource. Rows without any key match nothing; they are spread instead of
    meeting in one task.
    """
    a = F.col(attrs)
    values = F.array(*[a[n] for n in NATIVE_KEYS])
    name = lambda i: F.element_at(F.array(*map(F.lit, NATIVE_KEYS)), i + 1)
    keyed = df.withColumn("_res", F.when(F.coalesce(*[a[n] for n in NATIVE_KEYS]).isNotNull(), F.to_json(values)))
    known = keyed.where("_res is not null").select("_res", values.alias("_v")).distinct().select("_res", F.posexplode("_v").alias("_i", "_key")).where("_key is not null")
    hit = known.join(keys.select(F.col("key").alias("_key"), "asset_id"), "_key").groupBy("_res").agg(
        F.min_by(F.struct(name(F.col("_i")).alias("name"), F.col("_key").alias("value"), F.col("asset_id").alias("asset")), F.col("_i")).alias("_hit"))
    out = keyed.withColumn("_res", F.coalesce("_res", F.concat(F.lit("~"), F.spark_partition_id().cast("string")))).join(hit, "_res", "left")
    present = [F.when(a[n].isNotNull(), F.struct(F.lit(n).alias("name"), a[n].alias("value"),
                                                 F.lit(None).cast("string").alias("asset"))) for n in NATIVE_KEYS]
    out = out.withColumn("_id", F.coalesce("_hit", *present))
    tags = {t: fill_tag(a[src]) for t, src in TAG_ATTRIBUTE.items()}
    tags["service_name"] = fill_tag(a[TAG_ATTRIBUTE["service_name"]], default_service)
    return out.select(*df.columns, F.coalesce("_id.asset", F.lit(UNRESOLVED)).alias("asset_id"),
                      *[v.alias(k) for k, v in tags.items()], F.col("_id.asset").isNull().alias("orphan"),
                      F.col("_id.name").alias("key_name"), F.col("_id.value").alias("key_value"))


def with_keys(assets: DataFrame, keys: DataFrame) -> DataFrame:
    """Sorted key array per asset, empty when there are none."""
    k = keys.groupBy("asset_id").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return assets.join(k, "asset_id", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def new_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``asset_id`` for rows (``provider, name, ord``): the base id, or the lowest free ``base-n``.

    The k-th row of a base gets the k-th number no existing id uses. A used
    number u that is the j-th used one has u - j free ones before it; the k-th
    free number is k plus the used ones with fewer than k free before them.
    Both sides are put in one order, so nothing is paired with everything.
    """
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROVIDER_PREFIX.items() for x in kv]), F.col("provider")),
                        slug("provider"))
    w = wanted.withColumn("_base", F.concat_ws("-", F.lit("activo"), prefix, slug("name")))
    bases = w.select("_base").distinct()
    exact = taken.select("asset_id", F.col("asset_id").alias("_base"), F.lit(1).cast("bigint").alias("_u"))
    tail = taken.where(F.col("asset_id").rlike(r"-[1-9]\d{0,8}$")).select(
        "asset_id", F.regexp_replace("asset_id", r"-\d+$", "").alias("_base"),
        F.regexp_extract("asset_id", r"-(\d+)$", 1).cast("bigint").alias("_u")).where("_u >= 2")
    used = exact.unionByName(tail).join(bases, "_base", "left_semi").select("_base", "_u").distinct()
    by_base = W.partitionBy("_base")
    used = used.select("_base", (F.col("_u") - F.row_number().over(by_base.orderBy("_u"))).alias("_at"), F.lit(0).alias("_new"),
                       F.lit(None).cast("bigint").alias("ord"))
    asked = w.select("_base", F.row_number().over(by_base.orderBy("ord")).cast("bigint").alias("_at"), F.lit(1).alias("_new"), "ord")
    # used numbers with fewer than k free before them come before the k-th row
    line = used.unionByName(asked).withColumn("_before", F.sum(1 - F.col("_new")).over(
        by_base.orderBy((F.col("_at") - F.col("_new")), F.col("_new")).rowsBetween(W.unboundedPreceding, 0)))
    num = line.where("_new = 1").select("_base", "ord", (F.col("_at") + F.col("_before")).alias("_n"))
    out = w.join(num, ["_base", "ord"])
    return out.withColumn("asset_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(
        F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def reconcile(assets: DataFrame, keys: DataFrame, listing: DataFrame, provider: str, as_of: Column,
              retire_after: int = ABSENCES_TO_RETIRE) -> dict[str, DataFrame]:
    """U1 + A45: one SUCCESSFUL pass of one provider. A failed pass is simply not applied.

    ``assets``: asset_id, name, provider, region, env, origin, state, absences, seen_at, retired_at.
    ``keys``: key, asset_id, kind (nativo / host.name), provider.
    ``listing``: ord, native_id, name, region, env (in the order of the listing).
    Returns the new ``assets`` and ``keys``, ``conflicts`` and a one-row ``result``.
    """
    pass_rows = listing.withColumn("native_key", F.concat(F.lit(provider + ":"), "native_id"))
    native = keys.select(F.col("key").alias("native_key"), F.col("asset_id").alias("_by_native"))
    foreign = keys.where((F.col("kind") == "nativo") & (F.col("provider") != provider)).select("asset_id").distinct().withColumn(
        "_foreign", F.lit(True))
    name_keys = keys.select(F.col("key").alias("name"), F.col("asset_id").alias("_name_owner"), F.col("kind").alias("_name_kind"))
    owners = name_keys.join(foreign.withColumnRenamed("asset_id", "_name_owner"), "_name_owner", "left")
    r = pass_rows.join(native, "native_key", "left").join(owners, "name", "left")
    # inside the pass the first resource with a free name takes it; later ones of that name follow it
    first = pass_rows.groupBy("name").agg(F.min("ord").alias("_first"))
    r = r.join(first, "name").withColumn("_free", F.col("_name_owner").isNull())
    adopt = F.when((F.col("_name_kind") == "host.name") & F.col("_foreign").isNull(), F.col("_name_owner"))
    r = r.withColumn("_known", F.coalesce("_by_native", adopt))
    lead = r.where("_free and ord = _first").select("name", F.col("_known").alias("_lead_asset")).join(
        foreign.withColumnRenamed("asset_id", "_lead_asset"), "_lead_asset", "left").select(
        "name", "_lead_asset", F.col("_foreign").alias("_lead_foreign"))
    r = r.join(lead, "name", "left").withColumn(
        "_known", F.when(F.col("_free") & F.col("_lead_foreign").isNull(), F.coalesce("_known", "_lead_asset")).otherwise(F.col("_known")))
    follows = F.col("_known").isNull() & F.col("_free") & (F.col("ord") != F.col("_first")) & F.col("_lead_asset").isNull()
    r = r.withColumn("_follows", follows)
    fresh = new_ids(r.where("_known is null and not _follows").select(F.lit(provider).alias("provider"), "name", "ord"), assets).select(
        "ord", F.col("asset_id").alias("_new"))
    r = r.join(fresh, "ord", "left")
    leaders = r.where("ord = _first").select("name", F.coalesce("_known", "_new").alias("_lead_id"))
    r = r.join(leaders, "name").withColumn("asset_id", F.coalesce("_known", "_new", "_lead_id"))
    # five results are read from these rows, and new ids must be given once
    r = cut_lineage(r.select("ord", "name", "region", "env", "native_key", "asset_id", "_new", "_free", "_first", "_lead_id", "_name_owner"))

    owner = F.when(F.col("_free"), F.col("_lead_id")).otherwise(F.col("_name_owner"))
    conflicts = r.where(owner != F.col("asset_id")).select("name", "native_key", owner.alias("owner"), "asset_id")
    add = r.select(F.col("native_key").alias("key"), "asset_id", F.lit("nativo").alias("kind"), F.lit(provider).alias("provider")).unionByName(
        r.where("_free and ord = _first").select(F.col("name").alias("key"), F.col("_lead_id").alias("asset_id"),
                                                 F.lit("host.name").alias("kind"), F.lit(provider).alias("provider")))
    add = add.dropDuplicates(["key"])
    keys_out = keys.unionByName(add.join(keys.select("key"), "key", "left_anti").select(*keys.columns))

    # the last resource of an asset in listing order sets its name; region and environment keep the last non-null
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    seen = r.groupBy("asset_id").agg(F.max_by("name", "ord").alias("n_name"), last("region").alias("n_region"), last("env").alias("n_env"),
                                     F.bool_or(F.col("_new").isNotNull()).alias("is_new"))
    ours = keys.where((F.col("kind") == "nativo") & (F.col("provider") == provider)).select("asset_id").distinct().withColumn("ours", F.lit(True))
    j = assets.join(seen, "asset_id", "full").join(ours, "asset_id", "left")
    hit = F.col("n_name").isNotNull()
    missed = ~hit & F.coalesce("ours", F.lit(False)) & (F.col("state") == "activo")
    count = F.coalesce("absences", F.lit(0)) + 1
    retire = missed & (count >= retire_after)
    back = hit & (F.col("state") == "retirado")
    new_cols = {
        "name": F.coalesce("n_name", "name"), "provider": F.when(hit, F.lit(provider)).otherwise(F.col("provider")),
        "region": F.coalesce("n_region", "region"), "env": F.coalesce("n_env", "env"),
        "origin": F.coalesce("origin", F.lit("descubrimiento")),
        "state": F.when(hit, "activo").when(retire, "retirado").otherwise(F.col("state")),
        "absences": F.when(hit, 0).when(missed, count).otherwise(F.col("absences")).cast("int"),
        "seen_at": F.when(hit, as_of).otherwise(F.col("seen_at")),
        "retired_at": F.when(hit, F.lit(None)).when(retire, as_of).otherwise(F.col("retired_at"))}
    marked = j.withColumn("_retire", F.coalesce(retire, F.lit(False))).withColumn("_back", F.coalesce(back, F.lit(False)))
    result = marked.agg(F.count_if("is_new").alias("new"), F.count_if("_retire").alias("retired"), F.count_if("_back").alias("reactivated")).join(
        listing.agg(F.count(F.lit(1)).alias("seen")), F.lit(True)).join(conflicts.agg(F.count(F.lit(1)).alias("conflicts")), F.lit(True)).select(
        "seen", "new", "retired", "reactivated", "conflicts")
    assets_out = j.select("asset_id", *[v.alias(k) for k, v in new_cols.items()]).select(*assets.columns)
    return {"assets": assets_out, "keys": keys_out, "conflicts": conflicts, "result": result}


def admit(assets: DataFrame, keys: DataFrame, wanted: DataFrame) -> dict[str, DataFrame]:
    """``wanted``: key, asset_id, provider, name, region, env. A key of another asset goes to ``conflicts``."""
    owner = keys.select("key", F.col("asset_id").alias("owner"))
    j = wanted.join(owner, "key", "left")
    conflicts = j.where(F.col("owner").isNotNull() & (F.col("owner") != F.col("asset_id"))).select("key", "asset_id", "owner")
    ok = j.where(F.col("owner").isNull() | (F.col("owner") == F.col("asset_id")))
    blank = {"origin": F.lit("manual"), "state": F.lit("activo"), "absences": F.lit(0), "name": F.coalesce("name", "key"),
             "seen_at": F.lit(None).cast("timestamp"), "retired_at": F.lit(None).cast("timestamp")}
    add_a = ok.join(assets.select("asset_id"), "asset_id", "left_anti").dropDuplicates(["asset_id"]).select(
        *[(blank[c] if c in blank else F.col(c)).alias(c) for c in assets.columns])
    add_k = ok.where("owner is null").dropDuplicates(["key"]).select(
        *[(F.lit("host.name") if c == "kind" else F.col(c)).alias(c) for c in keys.columns])
    return {"assets": assets.unionByName(add_a), "keys": keys.unionByName(add_k), "conflicts": conflicts}


def provider_of(asset_id: Column) -> Column:
    """The provider from the id prefix."""
    c = F.lit("desconocido")
    for provider, p in PROVIDER_PREFIX.items():
        c = F.when(F.startswith(asset_id, F.lit(f"activo-{p}-")), provider).otherwise(c)
    return c


def known_identifiers(assets: DataFrame, keys: DataFrame) -> DataFrame:
    """``value, kind``; the first kind wins (asset id, name, then keys)."""
    parts = [assets.select(F.col("asset_id").alias("value"), F.lit(1).alias("p"), F.lit("ACTIVO").alias("kind")),
             assets.select(F.col("name").alias("value"), F.lit(2).alias("p"), F.lit("ANFITRION").alias("kind")),
             keys.select(F.col("key").alias("value"), F.lit(3).alias("p"),
                         F.when(F.instr("key", ":") > 0, "ID").otherwise("ANFITRION").alias("kind"))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null and value <> ''")
    return u.groupBy("value").agg(F.min_by("kind", "p").alias("kind"))


def resolvable(orphans: DataFrame, keys: DataFrame, pending_only: bool = False) -> DataFrame:
    """Orphans with the asset their key now resolves to; ``pending_only`` keeps what can be associated."""
    k = keys.select("key", F.col("asset_id").alias("resolves_to"))
    if pending_only:
        return orphans.where("associated_to is null").join(k, "key").orderBy("first_seen", "key")
    return orphans.join(k, "key", "left").orderBy(F.desc("last_seen"), "key")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last pass of each provider."""
    cols = [c for c in runs.columns if c != "provider"]
    return runs.groupBy("provider").agg(F.max_by(F.struct(*cols), F.struct("started", "run_id")).alias("r")).select("provider", "r.*")


def reassign(df: DataFrame, pending: DataFrame, fingerprint: list[str], ts: str | None = None) -> DataFrame:
    """Rows of an orphan host move to the asset its key resolves to.

    ``pending``: host_name, new_asset, and with ``ts`` also ``since``: rows
    before it stay (metrics are moved from two hours before the orphan was
    first seen). A moved row replaces the orphan row
    (where the reference's store could only copy); rows that already have their
    copy are not doubled, so a repeated run changes nothing. The fingerprint
    columns, not only their hash, decide what is the same row.
    """
    due = F.lit(True) if ts is None else F.col(ts) >= F.col("since")
    hit = F.coalesce((F.col("asset_id") == UNRESOLVED) & F.col("new_asset").isNotNull() & due, F.lit(False))
    moved = df.join(pending, "host_name", "left").withColumn("_hit", hit).withColumn(
        "reassigned", F.coalesce("reassigned", F.lit(False)) | F.col("_hit")).withColumn(
        "asset_id", F.when(F.col("_hit"), F.col("new_asset")).otherwise(F.col("asset_id")))
    # copies left by an interrupted earlier run: an orphan row equal to an already reassigned one is dropped
    done = df.where("reassigned").select("host_name", "asset_id", *fingerprint).distinct().select(
        *[F.col(c).alias(f"_d_{c}") for c in ["host_name", "asset_id", *fingerprint]])
    on = F.lit(True)
    for c in ["host_name", "asset_id", *fingerprint]:
        on = on & F.col(c).eqNullSafe(F.col(f"_d_{c}"))
    again = moved.where("_hit").join(done, on, "left_anti")
    return moved.where("not _hit").select(*df.columns).unionByName(again.select(*df.columns))
