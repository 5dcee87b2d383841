"""Whitening, packing and the manifest: brute force, edge cases, plan bounds."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.llm import bpe, merkle, packing, queries, whitening

from ..conftest import plan_of

# --- whitening ---


def plain_whitening(vectors, top=16):
    """The contract in NumPy: integers, distinct rows, centred covariance, eigenvectors."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (u * n - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:top], q[:, ::-1][:, :top]
    white = (x * n - s) / n @ q / np.sqrt(e)
    return n, np.square(x * n - s).sum(axis=1), white, e / np.trace(v)


def rows_of(df):
    out = defaultdict(list)
    for r in df.orderBy("component").collect():
        out[r["vec_id"]].append(r)
    return out


def embeddings(spark, rows):
    full = [(i, v, 3, "x", b"y", 0) for i, v in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, n int, component string, x binary, whitened int")


def test_whitening_matches_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, white, share = plain_whitening([r["embedding"] for r in rows])
    found = rows_of(queries.QUERIES["op11_embedding_whitening"](spark, sf))
    assert sorted(found) == [r["vec_id"] for r in rows]
    for i, r in enumerate(rows):
        mine = found[r["vec_id"]]
        assert [m["component"] for m in mine] == list(range(1, 17))
        assert {m["n"] for m in mine} == {n} and {m["deviation"] for m in mine} == {deviation[i]}
        assert np.allclose(np.abs([m["whitened"] for m in mine]), np.abs(white[i]), atol=1e-9)
        assert np.allclose([m["explained"] for m in mine], share, rtol=1e-9)
    assert max(m["identity_error"] for m in found[rows[0]["vec_id"]]) < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    repeated = [(100 + i, good[0][1]) for i in range(60)]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [math.nan] * 5), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [1e30] * 5)]
    found = rows_of(whitening.whiten(embeddings(spark, good + repeated + bad + [(None, good[1][1]), (3, good[3][1])])))
    assert set(found) == {i for i, _ in good + repeated} | {None}
    assert len(found[3]) == 10 and found[3][0]["n"] == 40
    assert [r["whitened"] for r in found[100]] == [r["whitened"] for r in found[0]]
    want = plain_whitening([v for _, v in good])[2]
    assert np.allclose(np.abs([r["whitened"] for r in found[7]]), np.abs(want[7]), atol=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(embeddings(spark, rows)).count() == 0


def test_whitening_of_mixed_widths_and_few_dimensions(spark):
    found = rows_of(whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [3.0]), (3, [3.0, 0.0]), (4, [-1.0, 1.0])])))
    assert [r["whitened"] for r in found[2]] == [r["whitened"] for r in found[3]]
    assert all(len(r) == 2 and r[0]["n"] == 3 for r in found.values())


def test_deviations_beyond_a_machine_word():
    model = whitening.Whitening(3, np.array([5]), np.array([1]), np.zeros((0, 1)), np.zeros(0), 1.0, 0.0)
    assert model.deviations(np.array([[7], [5 + (1 << 44)]])) == [25, None]


@pytest.mark.parametrize("kind", ["spread", "equal", "pairs", "low rank", "geometric", "shift met"])
def test_divide_and_conquer_finds_eigenvectors(kind):
    rng = np.random.default_rng(5)
    m = 24
    values = {
        "spread": rng.uniform(1, 9, m), "equal": np.full(m, 2.0), "pairs": np.repeat(rng.uniform(1, 9, m // 2), 2),
        "low rank": np.r_[rng.uniform(1, 9, 6), np.zeros(m - 6)], "geometric": 3.0 ** -np.arange(m), "shift met": np.r_[np.zeros(8), np.ones(8), np.full(8, 2.0)],
    }[kind]
    q = np.linalg.qr(rng.normal(size=(m, m)))[0]
    v = q * values @ q.T
    e, found = whitening.leading_components((v + v.T) / 2, 16)
    want = np.sort(values)[::-1][:16]
    want = want[want > m * 8 * whitening.EPS * want[0]]
    assert np.allclose(e, want, atol=1e-12)
    assert np.allclose(found @ found.T, np.eye(len(e)), atol=1e-12)
    assert np.allclose(v @ found.T, found.T * e, atol=1e-12)


def test_polar_sign_is_the_sign():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    for values in (rng.normal(size=9), np.r_[1e-9, -1e-7, rng.normal(size=7)]):
        assert np.allclose(whitening.polar_sign(q * values @ q.T), q * np.sign(values) @ q.T, atol=1e-6)


# --- packing ---


@pytest.fixture(scope="module")
def words():
    return bpe.read_model(queries.tokenizer_path("word_bpe_49k.json"))


ODD = (
    "<|endoftext|> a <|STARTOFTEXT|> b<|startoftext|>c 'S it's DON'T ''s \x1c \x85 \xa0 É é é İ Σας ΣΑΣ ǅ ½ ² ª º × ÷ "
    "  ﻿ x​y 中文字 ١٢ 12a3 _a_ <| |> #!$ Zürich, NAÏVE? " + "long" * 400
)


def test_words_match_the_library(spark, sf, words):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_str(words), packing.WordEncoder(words)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in [*texts, ODD, "", " \t"]:
        assert array("I", encoder.encode(text.encode())).tolist() == library.encode(text, add_special_tokens=False).ids


def test_word_tables_start_anew(words, monkeypatch):
    encoder = packing.WordEncoder(words)
    want = encoder.encode(b"one two three")
    monkeypatch.setattr(packing, "WORDS", 2)
    assert encoder.encode(b"one two three") == want and len(encoder) == 3


def plain_best_fit(lengths, capacity):
    """Free tokens of each sequence after best fit in falling order, piece by piece."""
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(capacity - length)
    return sorted(free)


@pytest.mark.parametrize("seed", range(6))
def test_planning_over_counts_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 50, 400]))] + [rng.randint(1, capacity)] * rng.choice([0, 300])
    counts = {k: lengths.count(k) for k in set(lengths)}
    slots, opened = packing.plan_slots(counts, capacity)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, first, bins, each, bin_, offset in slots:
        for i in range(bins * each):
            ranks[length].append(first + i)
            used[bin_ + i // each].append((offset + i % each * length, length))
    assert {k: sorted(r) for k, r in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(opened))
    assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, capacity)


def test_the_plan_does_not_grow_with_the_documents():
    rng = random.Random(1)
    counts = {k: rng.randint(1, 30) for k in range(1, 513)}
    small = len(packing.plan_slots(counts, 512)[0])
    large = len(packing.plan_slots({k: n * 1_000_000 for k, n in counts.items()}, 512)[0])
    assert large < 4 * small + 4 * 512


def documents(spark, rows):
    full = [(i, t, "x", 1, 2, 3, b"z", 4) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, piece string, length int, sequence_id int, offset int, ids binary, _row int")


@pytest.mark.parametrize("chunk", [2, 1024])
def test_packing_edges(spark, words, monkeypatch, chunk):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CHUNK", chunk)
    monkeypatch.setattr(packing, "PART", chunk + 1)
    library, capacity = Tokenizer.from_str(words), 16
    rows = [(1, None), (2, ""), (3, "the " * 100), (4, "same text"), (4, "same text"), (None, "no id"), (5, ODD), (6, "a " * 15), *[(i, "hot") for i in range(10, 60)]]
    packed = packing.pack(packing.encode_pieces(documents(spark, rows), words, capacity=capacity), capacity)
    found = packed.collect()
    want = defaultdict(int)
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), capacity):
            want[key, at // capacity, at, array("I", ids[at : at + capacity]).tobytes()] += 1
    got = defaultdict(int)
    for r in found:
        got[r["doc_id"], r["piece"], r["start"], bytes(r["ids"])] += 1
        assert r["length"] * 4 == len(r["ids"])
    assert got == want
    assert sum(k[0] == 6 for k in got) == 1
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for r in packing.sequences(packed).collect():
        parts = sorted(held.pop(r["sequence_id"]))
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:i]) for i in range(len(parts))]
        assert bytes(r["ids"]) == b"".join(p[2] for p in parts) and r["length"] == len(r["ids"]) // 4 <= capacity
    assert not held


def test_packing_an_empty_table(spark, words):
    out = packing.pack(packing.encode_pieces(documents(spark, []), words))
    assert out.count() == 0 and {"sequence_id", "offset"} <= set(out.columns)


def test_packing_query_uses_few_sequences(spark, sf):
    out = queries.QUERIES["op12_best_fit_packing"](spark, sf).collect()
    total = sum(r["length"] for r in out)
    assert len({r["sequence_id"] for r in out}) <= -(-total // packing.CAPACITY) + 1
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out[0].asDict())


# --- manifest ---


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The last node and, for each first one, its siblings level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, k in enumerate(at):
            run = runs[k // 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
            at[i] = k // 3
        nodes = [digest(*run) for run in runs]
    return (nodes[0] if nodes else None), paths


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for row in rows:
        key, text = row[0], row[4]
        seen = text.replace("\n", "") if text is not None and key is not None and zlib.crc32(str(key).encode()) % 2 == 0 else text
        groups[row[1]].append((key, digest(*map(written, row)), digest(*map(written, (*row[:4], seen)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_tree([r[1] for r in groups[s]])
    root, upper = plain_tree([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (key, leaf, seen), path in zip(groups[s], trees[s][1], strict=True):
            proof, node = "", seen
            for left, right in [*path, *above]:
                proof, node = proof + left + right, digest(left, node, right)
            out.append((key, leaf, trees[s][0], root, digest(proof), node, node == root))
    return sorted(out, key=str)


def manifest_of(spark, tmp_path, rows):
    full = [(*r, 1, "x", 2) for r in rows]
    table = spark.createDataFrame(full, "doc_id long, source string, lang string, n_chars long, text string, pos int, grp string, leaf int")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


@pytest.mark.parametrize("sizes", [(), (1,), (3,), (4, 1), (2, 9, 10, 27, 28), (245,), (1, 730, 1, 1)])
def test_manifest_matches_plain_trees(spark, tmp_path, sizes):
    rows = [(100 * k + 3 * i - 50, f"s{k}" if k else None, "en", i, f"text\n{i}") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_edges(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (2, "", None, 5, None), (7, "é", "fr", 3, "é\n\nü"), (7, "é", "fr", 3, "é\n\nü")]
    rows += [(7, "é", "fr", 4, "other"), (8, "z", "en", 1, "\n"), (-9, "z", "en", 1, "a\n" * 200_000), (9, "n", "en", 1, "a")] + [(5, "hot", "en", 1, "copy")] * 300
    assert manifest_of(spark, tmp_path, rows) == plain_manifest(rows)


def test_manifest_blocks_share_no_task(spark, sf):
    """Windows and joins are dealt by (group, block) or (group, part), never by the group."""
    plan = plan_of(queries.QUERIES["op13_merkle_manifest"](spark, sf))
    dealt = [line for line in plan.splitlines() if "hashpartitioning(grp" in line and "Exchange" in line]
    assert any("block" in line for line in dealt)
