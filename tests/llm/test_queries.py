"""Registered text queries against DuckDB, and the pipeline against plain code."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from checks.compare import compare, connect
from layerframe.llm import mixing, queries

from .test_operators import plain_chunks, plain_components, plain_targets


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf, name):
    good, note = compare(spark, sf, name, queries.QUERIES[name], queries.ORACLES[name], connect(sf))
    assert good, note


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What went into each stage, and the result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = [docs]
    for name, stage in corpus_pipeline.STAGES:
        held.append(corpus_pipeline.store(stage(spark, held[-1], sf), f"test-{name}"))
    return held


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_keep_the_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    assert stages[1].count() == stages[0].filter("text rlike '[A-Za-z]'").count()


def test_repeated_lines_go(stages):
    seen, want = set(), []
    for key, text in sorted(rows(stages[1])):
        kept = [c for c in plain_chunks(text) if len(c) == 1 or tuple(c) not in seen]
        seen |= {tuple(c) for c in kept if len(c) > 1}
        if kept and "".join(sum(kept, [])).strip() or len(kept) == len(plain_chunks(text)):
            want.append((key, "\n".join("\n".join(c) for c in kept)))
    assert rows(stages[2]) == sorted(want, key=str)


def test_one_of_each_group_stays(stages):
    before = rows(stages[2])
    groups = plain_components(before, corpus_pipeline.WORDS)
    assert [k for k, _ in rows(stages[3])] == sorted((k for k, (_, c) in groups.items() if k == c), key=str)


def test_mix_repeats_documents(stages):
    sizes = Counter()
    for r in stages[3].collect():
        sizes[r["source"]] += len(r["text"].split())
    got, largest = Counter(), max(len(r["text"].split()) for r in stages[3].collect())
    for r in stages[4].select("source", mixing.word_count(stages[4]["text"]).alias("n")).collect():
        got[r["source"]] += r["n"]
    for source, target in plain_targets(sizes).items():
        assert abs(got[source] - target) <= largest
    assert max(Counter(k for k, _ in rows(stages[4])).values()) <= 2


def test_tokens_decode_to_the_texts(stages):
    assert rows(stages[5]) == rows(stages[4])
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in stages[5].collect())


def test_pipeline_runs_on_an_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHING = "_row long, kept_id long, reading int, readings int, at_id long, at_source string, at_size long, removed_chunks int, n_lines int, id long, text2 string"


def edge_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, copies, and columns with clashing names."""
    words = [f"wort{i} lang{i * 7 % 31}" for i in range(300)]
    text, other = " ".join(words), " ".join(words[::-1])
    long = " ".join(f"only{i}" for i in range(50_000))
    lines = "\n".join(f"line {i} of the common passage" for i in range(12))
    rows = [
        (5, text, "en", "a"), (None, text, "en", "a"), (None, other, "en", None), (None, other + " more", "en", None), (6, text + " end", None, "b"),
        (7, None, "en", "a"), (8, "", "en", "a"), (9, long, "en", "a"), (9, long, "en", "a"), (10, f"{lines}\nfirst tail", "en", "a"),
        (11, f"{lines}\nsecond tail", "en", "b"), (12, text + " x", "en", "a"), (12, "another text under the same id", "en", "a"),
    ]
    own = (1, 2, 3, 4, 5, "s", 6, 77, 88, 9, "t")
    df = spark.createDataFrame([(*r, len(r[1] or ""), *own) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    return df, own


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_pass_clashing_columns_through(spark, sf, name):
    docs, own = edge_documents(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    assert out.columns == docs.columns
    found = out.collect()
    assert found and {tuple(r)[5:] for r in found} == {own}


def test_near_duplicates_of_null_and_repeated_ids(spark, sf):
    docs, _ = edge_documents(spark)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:12]) for r in kept) == sorted([
        (5, "wort0 lang0 "), (0, "wort299 lang"), (7, ""), (8, ""), (9, "only0 only1 "), (10, "line 0 of th"), (12, "another text"),
    ])


def test_every_stage_on_an_empty_table_with_extra_columns(spark, sf):
    docs = edge_documents(spark)[0].limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).count() == 0
