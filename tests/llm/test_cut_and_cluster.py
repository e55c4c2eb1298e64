import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loadweave.llm import clusters, fill_in_middle, sentence_pieces
from loadweave.llm.queries import ORACLE, QUERIES
from oracle import compare, duck

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# --- Fill in the middle -----------------------------------------------------------------------


def brute_fim(doc_id, text, unit="line"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["line", "char"])
def test_fill_in_middle_of_odd_texts(spark, docs, odd_texts, unit):
    rng = random.Random(3)
    rows = odd_texts + [(100 + i, "".join(rng.choice(["a", "é", "中", "\U0001f600", "\n", "\n\n", " ", "\r"]) for _ in range(rng.randrange(60))))
                        for i in range(150)]
    rows += [(300, "\n"), (301, "\n\n\n"), (302, "x"), (303, "a <M> b\nc"), (304, "line\n" * 40_000), (305, "<P"), (306, "\n" * 1000 + "é" * 999)]
    got = fill_in_middle.restore(fill_in_middle.transform(docs(rows), unit=unit)).collect()
    assert len(got) == len(rows)
    seen = sorted((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got)
    assert seen == sorted((str(i), *brute_fim(i, t, unit)) for i, t in rows)
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert {"lang", "label", "id"} <= set(got[0].asDict())


def test_fill_in_middle_replaces_clashing_columns_and_keeps_empty_tables(spark, docs):
    rows = docs([(1, "a\nb\n")]).withColumn("n", F.lit("x")).withColumn("_form_0", F.lit(5)).withColumn("output", F.lit(1))
    row = fill_in_middle.transform(rows).first()
    assert row["n"] == 2 and row["_form_0"] == 5 and row["output"] == brute_fim(1, "a\nb\n")[4]
    assert fill_in_middle.restore(fill_in_middle.transform(docs([]))).count() == 0
    assert fill_in_middle.transform(docs([(1, "a\nb")]), percent=0).first()["form"] == "plain"
    with pytest.raises(ValueError):
        fill_in_middle.ending_marks(np.zeros(1, "<u8"), "word")


def test_marked_bytes_against_plain_counting():
    rng = np.random.default_rng(5)
    for density in (0.0, 0.02, 0.5, 1.0):
        raw = np.where(rng.random(1003) < density, 10, rng.integers(0, 256, 1003)).astype(np.uint8)
        marked = fill_in_middle.Marked(fill_in_middle.equal_marks(fill_in_middle.as_words(raw), 10))
        places = np.flatnonzero(raw == 10)
        assert (marked.select(np.arange(len(places))) == places).all()
        at = np.arange(len(raw) + 1)
        assert (marked.rank(at) == np.concatenate([[0], np.cumsum(raw == 10)])).all()


# --- Centroid clustering ----------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim, seed=2, scale=256):
    kept = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    name = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    order = sorted(range(len(kept)), key=lambda j: (name[j], kept[j][1].tolist()))[:k]
    x, c = np.array([v for _, v in kept]), np.array([kept[j][1] for j in order])

    def near():
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = near()
        for j in np.unique(a):
            c[j] = x[a == j].sum(0) // (a == j).sum()
    a, d = near()
    return sorted((str(kept[i][0]), int(a[i]), int(d[i]), int(d[a == a[i]].sum()), int(d.sum()), c[a[i]].tolist()) for i in range(len(kept)))


def run_clusters(spark, rows, k, rounds, dim):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, v int")
    found = clusters.cluster(table, dim=dim, k=k, rounds=rounds).collect()
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in found)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (500, None), (501, [0.0] * 7), (502, [None] + [0.0] * 7),
             (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7), (505, [0.0] * 8)]
    for k, rounds in ((1, 2), (7, 5), (60, 3)):
        assert run_clusters(spark, rows, k, rounds, 8) == brute_clusters(rows, k, rounds, 8)


def test_clusters_of_ties_few_rows_and_none(spark):
    same = [(i, [0.5, -0.25]) for i in range(30)] + [(40, [0.5, 0.25])]
    assert run_clusters(spark, same, 5, 3, 2) == brute_clusters(same, 5, 3, 2)  # equal centroids: the smaller number
    few = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert run_clusters(spark, few, 40, 5, 2) == brute_clusters(few, 40, 5, 2)
    assert run_clusters(spark, [(1, None)], 40, 5, 2) == [] and run_clusters(spark, [], 3, 1, 2) == []
    assert len(run_clusters(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 0.0])], 2, 2, 2)) == 3


def test_cluster_bounds_never_exceed_distances():
    rng = np.random.default_rng(8)
    x = np.floor(256 * rng.normal(size=(500, 16)) * np.geomspace(4, 0.05, 16)).astype(np.int64)
    rotation = clusters.Rotation(x.mean(0), np.linalg.qr(rng.normal(size=(16, 16)))[0][:, :5])
    search = clusters.Filter(rotation, x[:12])
    lead, rest = rotation.project(x.astype(float))
    true = ((x[:, None] - x[None, :12]) ** 2).sum(2)
    assert (search.bounds(lead, rest) <= true).all()
    near, distance, measured = search.nearest(x, lead, rest)
    assert (near == true.argmin(1)).all() and (distance == true.min(1)).all() and measured < true.size


def test_principal_axes_prune_most_centroids(spark):
    rng = np.random.default_rng(4)
    centres = 3 * rng.normal(size=(30, 3)) @ rng.normal(size=(3, 24))
    x = centres[rng.integers(0, 30, 900)] + 0.1 * rng.normal(size=(900, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = clusters.quantise(table, scale=256, dim=24)
    rotation = clusters.fit_rotation(whole, 24)
    ints = np.floor(256 * x).astype(np.int64)
    search = clusters.Filter(rotation, ints[:30])
    _, _, measured = search.nearest(ints, *rotation.project(ints.astype(float)))
    assert rotation.axes.shape[1] <= 3 and measured < 0.2 * 900 * 30


# --- SentencePiece ----------------------------------------------------------------------------


def library_spans(library, text):
    message = library.encode(text, return_type="serialized_proto")
    pieces = [{n: v for n, v, _ in sentence_pieces.fields(p)} for i, p, _ in sentence_pieces.fields(message) if i == 2]
    return [(p.get(4, 0), p.get(5, 0)) for p in pieces]


def test_sentence_pieces_against_the_library(spark, docs, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(9)
    rows = odd_texts + [(100 + i, "".join(rng.choice("ab e▁ \n\té\U0001f600\U00013000中,.<s>0\x00") for _ in range(rng.randrange(50))))
                        for i in range(200)]
    rows += [(400, " " * 300), (401, "▁▁ ▁"), (402, "中文没有空格" * 3000), (403, " x " * 20_000)]
    got = sentence_pieces.encode(docs(rows).withColumn("ids", F.lit(1)), PIECES, decoded="decoded").collect()
    assert len(got) == len(rows) and "label" in got[0]
    for r in got:
        text = r["text"] or ""
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == library.decode(want) == text.replace("▁", " ")
        spans, size = list(zip(r["begins"], r["ends"])), len(text.encode())
        assert spans[1:-1] == library_spans(library, text) and spans[0] == (0, 0) and spans[-1] == (size, size)
    bare = sentence_pieces.encode(docs([(1, "a b")]), PIECES, add_begin=False, add_end=False)
    assert np.frombuffer(bare.first()["ids"], "<u4").tolist() == library.encode("a b")
    assert sentence_pieces.encode(docs([]), PIECES).count() == 0


def test_decoding_of_any_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(4)
    lists = [[rng.choice([rng.randrange(260), rng.randrange(32000), 28705, 264]) for _ in range(rng.randrange(12))] for _ in range(400)]
    coded = spark.createDataFrame([(i, bytearray(np.array(v, "<u4").tobytes())) for i, v in enumerate(lists)], "i int, ids binary")
    got = {r["i"]: r["decoded"] for r in sentence_pieces.decode(coded, PIECES).collect()}
    assert got == {i: library.decode(v) for i, v in enumerate(lists)}
    nulls = spark.createDataFrame([(1, None), (2, bytearray())], "i int, ids binary")
    assert [r["decoded"] for r in sentence_pieces.decode(nulls, PIECES).collect()] == ["", ""]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normaliser_with_a_character_map(rule):
    rng = random.Random(6)
    texts = ["ﬁ Ａ  b", "ｶﾞ ﷺ ㌀", " é´ x　　y", "각 각", "﻿abc  ", "", "   ", " x▁", "▁ ▁"]
    texts += ["".join(rng.choice("Aaè́̈  ｶﾞﬁ㌀Ⅷß´İ　각ﷺ‍\n▁") for _ in range(rng.randrange(30))) for _ in range(200)]
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = b"".join(v for n, v, _ in sentence_pieces.fields(library.serialized_model_proto()) if n == 3)
    mine = sentence_pieces.Normaliser(spec)
    assert len(mine.map) > 100_000
    for prefix in (True, False):
        for trim in (True, False):
            library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=trim)
            mine.prefix, mine.trim = prefix, trim
            for text in texts:
                want, origin = library.normalize(text, with_offsets=True)
                got, align = mine.one(text)
                assert got == want
                byte = np.cumsum([0] + [len(c.encode()) for c in text])
                if want:
                    at = np.cumsum([0] + [len(c.encode()) for c in want])
                    assert align[at].tolist() == byte[list(origin)].tolist()


# --- Registered queries -----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_clusters", "op13_fill_in_middle"])
def test_query_against_sql(spark, sf, name):
    problems, rows, _ = compare(spark, duck(sf), sf, QUERIES[name], ORACLE[name])
    assert not problems and rows


def test_sentence_piece_query(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: r for r in QUERIES["op12_sentence_pieces"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_a_batch_equal_those_of_single_texts():
    model = sentence_pieces.Pieces(PIECES)
    texts = ["a b", None, "", "c  d\n", "é"]
    coded, begins, _ = model.encode(pa.array(texts, pa.string()), True, True)
    single = [model.encode(pa.array([t], pa.string()), True, True) for t in texts]
    assert coded == [s[0][0] for s in single]
    assert begins.tolist() == [x for s in single for x in s[1].tolist()]
