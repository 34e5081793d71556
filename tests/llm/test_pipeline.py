"""The whole pipeline against plain versions of its stages, and the registration of the queries."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_native, test_neardup
from tests.llm.helpers import DOCS, SF, awkward, docs_of, read
from tidegauge.llm import quality, secrets


def plain_mask(t):
    out, end = "", 0
    spans, merged = test_native.plain_spans(t), []
    for a, _, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out, end = out + t[end:a] + "[secret]", b
    return out + t[end:]


def test_run_equals_plain_stages(spark):
    rows = [(r.doc_id, r.text or "") for r in read(spark, "documents").collect()]
    counts = [quality._measure(t) for _, t in rows]
    codes, n = np.unique([quality.pattern(c) for c in counts], return_counts=True)
    p = dict(zip(codes, quality.fit(quality.unpack(codes), n)[0]))
    rows = [r for r, c in zip(rows, counts) if not quality.failed(c) and p[quality.pattern(c)] >= 0.5]
    kept = {i for i, _, _, k in test_neardup.plain(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    dirty = {h[0] for h in test_native.plain_hits(rows, items) if h[5]}
    rows = [(i, plain_mask(t)) for i, t in rows if i not in dirty]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == want and 0 < len(want) < 200


def test_stages_keep_the_columns_and_take_awkward_rows(spark, folder):
    for n, docs in enumerate((awkward(spark), docs_of(spark, []))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == DOCS.names
            out.write.parquet(f"{folder}/{n}-{k}")
            docs = spark.read.parquet(f"{folder}/{n}-{k}")
    # the stages one by one, on rows that reach them
    d = docs_of(spark, [(1, "token = abcdefgh1 x"), (2, "token = abcdefgh1 x"), (2, "token = abcdefgh1 x"), (None, "token = abcdefgh1 x"), (None, None), (3, "")])
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.keep_one_copy(spark, d, SF).collect()) == [0, 0, 1, 3]
    masked = corpus_pipeline.mask_secrets(spark, d, SF).collect()
    assert {(r.text, r.n_chars) for r in masked} == {("[secret] x", 10), (None, None), ("", 0)} and len(masked) == 6
    assert secrets.RULES[0].kind == "assign"


def test_every_operator_is_registered():
    sys.path.insert(0, str(Path(corpus_pipeline.__file__).parent))
    import __spark_entry__ as entry
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {"op2_secrets", "op3_licenses", "op7_decontamination"} <= set(entry.oracle_sql())
