"""The pipeline over awkward tables, each stage against a brute-force version of it on what the stage before kept."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from millrace.llm import quality
from tests.llm import test_decontaminate, test_lines, test_neardup
from tests.llm.tables import frame


def tables(spark, path, docs):
    frame(spark, docs, extra=True).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d % 5 > 0), 0) for d, *_ in docs if d is not None and d < 60]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(docs[2][1].split()[:15])), (2, docs[75][1]), (3, ""), (4, None), (None, "no such words here")] if docs else []
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_pipeline_against_brute_force(spark, tmp_path, kind):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing columns; and empty tables."""
    docs = test_lines.rows() if kind == "awkward" else []
    items = tables(spark, str(tmp_path), docs)
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = kept.columns
    stages = dict(corpus_pipeline.STAGES)
    # quality: the trees' own predictions, read off the scores
    new = stages["quality"](spark, kept, str(tmp_path)).cache()
    model = quality.train(kept, spark.read.parquet(f"{tmp_path}/labels.parquet"), "quality", (3, 1))
    want = [(r["doc_id"], r["score"] >= 0.5) for r in quality.scored(kept, model).collect()]
    assert new.columns == columns and sorted(map(str, (d for d, _ in plain(new)))) == sorted(str(d) for d, good in want if good)
    # lines
    before, new = plain(new), stages["lines"](spark, new, str(tmp_path)).cache()
    assert new.columns == columns
    want = sorted(((d, x) for d, _, _, x in test_lines.brute_runs([(d, t) for d, t in before])), key=str)
    assert sorted(((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in plain(new)), key=str) == want
    # near duplicates: one row of each group that has a set; all rows without one
    before, new = plain(new), stages["near_duplicates"](spark, new, str(tmp_path)).cache()
    assert new.columns == columns
    groups = {d: c for d, n, c in test_neardup.brute([(d, t) for d, t in before], 5) if n and d is not None}
    ids = [d for d, t in plain(new) if (t or "").split() and d is not None]
    assert sorted(groups[d] for d in ids) == sorted(set(groups.values())) and sum(not (t or "").split() for _, t in plain(new)) == sum(not (t or "").split() for _, t in before)
    # benchmark
    before, new = plain(new), stages["benchmark"](spark, new, str(tmp_path)).cache()
    assert new.columns == columns
    want = [r[0] for r in test_decontaminate.brute([(d, t) for d, t in before], items, 10) if not r[5]]
    assert sorted(map(str, (d for d, _ in plain(new)))) == sorted(map(str, want))
    # tokens
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = stages["tokens"](spark, new, str(tmp_path))
    want = []
    for d, t in plain(new):
        code = codec.encode_ordinary(t or "")
        want.append((d, len(code), hashlib.sha256(",".join(map(str, code)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, out.collect()))
    if docs:
        assert 0 < len(got) < len(docs)
