"""The pipeline against its stages told plainly, and the registered queries."""

import hashlib

import corpus_pipeline
import public_tokenizers
import pytest
import test_ops as T
import tiktoken
from conftest_llm import make

import __spark_entry__
from leadspark.llm import bpe
from leadspark.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tables(spark, corpus, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    docs, labels, _ = T.toxic_set(spark, 300)
    texts = corpus + [r.text for r in docs.orderBy("doc_id").collect()]
    bench = [(1, " ".join(texts[3].split()[:20]) if len(texts[3] or "") > 200 else "q " * 20), (2, " ".join(f"bench{i}" for i in range(30)))]
    texts.append("intro words here " + bench[1][1] + " tail")
    make(spark, texts).write.parquet(f"{d}/documents.parquet")
    labels.selectExpr(f"doc_id + {len(corpus)} as doc_id", "quality", "toxic").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.net/", None), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d), texts, bench, {r.doc_id + len(corpus) for r in labels.filter("toxic = 1").collect()}


def test_pipeline(spark, tables):
    sf_dir, texts, bench, toxic = tables
    left = {i: t for i, t in enumerate(texts) if i not in toxic}
    ids = list(left)
    classes = T.classes([left[i] for i in ids], 5, 80)
    left = {ids[k]: left[ids[k]] for k, v in classes.items() if v[2]}
    ids = list(left)
    cut = cut_texts([left[i] for i in ids])
    left = {i: c for i, c in zip(ids, cut, strict=True) if not T.judged(c, bench)[-1]}
    v = bpe.tokenizer(T.PATH, public_tokenizers.PATTERN).v
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.rank, special_tokens={})
    expected = {i: (len(x := real.encode_ordinary(t)), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected and len(texts) - 1 not in got


def test_pipeline_on_odd_rows(spark, odd, clashing, tmp_path):
    """Nulls, repeated rows, clashing columns and no rows at all go through every stage."""
    bench, labels = "item_id long, text string", "doc_id long, quality int, toxic int"
    kept = {}
    for name, docs in (("plain", odd), ("crowded", clashing), ("none", odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(None, None)], bench).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([(3, 1, 0), (None, None, 1)], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == spark.read.parquet(f"{tmp_path}/{name}/documents.parquet").columns
        kept[name] = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect())
    assert kept["plain"] == kept["crowded"] and kept["none"] == []
    assert [i for n, i, _ in kept["plain"] if not n] == [0, 1, 2, 3, 4, 5, 6, 6, 8, 9] and kept["plain"][-1][0]  # 7 is a copy of 6


def cut_texts(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out.append(bytes(x for x, c in zip(b, cover, strict=True) if not c).decode("utf-8", "ignore"))
    return out


def test_registered():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "passage_dedup", "decontamination", "tokens"]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_return_all_rows(spark, tables, name):
    sf_dir, texts, *_ = tables
    rows = QUERIES[name](spark, sf_dir)
    assert rows.count() == (2 if name.startswith("op6") else len(texts))
