"""Language ID, toxicity, BPE, decontamination, line de-duplication and token files."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loadweave.llm import bpe, decontaminate, language_id, line_dedup, queries, token_files, toxicity
from loadweave.llm.common import HashArray, slices, table

PATH = queries.TOKENIZER


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def rows(df, *key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: str(r))


def test_hash_array_finds_what_it_holds():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    found = HashArray(keys).find(np.concatenate([keys, keys + np.uint64(1), [np.uint64(2**64 - 1)]]))
    assert (found[:len(keys)] == np.arange(len(keys))).all() and (found[len(keys):] == -1).all()
    assert (HashArray(keys[:0]).find(keys) == -1).all()


def test_slices_keep_rows_whole():
    batch = pa.record_batch({"text": ["a" * 9, None, "b" * 50, "", "c"]})
    parts = list(slices(batch, "text", 10))
    assert [p.num_rows for p in parts] == [2, 1, 2] and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()


# --- language ID -----------------------------------------------------------------------------------------------

WORDS = {"aa": "the quick river ran under old stones while many birds sang".split(),
         "bb": "zorü xakki bölun möpp tirrä kazzo üllen wapp".split()}


def corpus(n=400, seed=3):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[k]) for _ in range(r.randint(3, 60))), k)
            for i, k in ((i, r.choice(sorted(WORDS))) for i in range(n))]


def test_language_of_unseen_texts(spark, docs):
    model = language_id.fit(docs(corpus()))
    found = {r["doc_id"]: r for r in language_id.identify(docs(corpus(100, 9)), model).collect()}
    truth = {i: k for i, _, k in corpus(100, 9)}
    assert all(found[i]["lang_pred"] == truth[i] and 0.5 < found[i]["score"] <= 1 for i in truth)
    assert not any(r["rejected"] for r in found.values())
    odd = language_id.identify(docs([(1, "qqqq jjjj wwww qjqj " * 40)]), model).first()
    assert odd["rejected"]


def test_language_of_odd_texts(spark, docs, odd_texts):
    model = language_id.fit(docs(corpus()))
    found = language_id.identify(docs(odd_texts), model)
    assert found.count() == len(odd_texts)
    for r in found.where("doc_id < 4").collect():
        assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert language_id.identify(docs([]), model).count() == 0
    kept = language_id.keep_identified(docs(odd_texts), model)
    assert kept.columns == docs([]).columns and kept.where("doc_id < 4").count() == 0
    nothing = language_id.fit(docs([(1, None, "aa"), (2, "text", None)]))
    assert {r["lang_pred"] for r in language_id.identify(docs(odd_texts), nothing).collect()} == {"und"}


def test_kneser_ney_sums_to_one(spark, docs):
    model = language_id.fit(docs(corpus()))
    alphabet = [g for g in "abcdefghijklmnopqrstuvwxyzöüä "]
    text = pa.array(["".join(["rive", c]) for c in alphabet], pa.large_string())
    # what may follow " rive" inside a word, and the end of the word: no more than everything
    shorter = -model.entropies(pa.array(["riv"], pa.large_string()))[0] * 4
    assert np.isfinite(shorter).all() and (model.entropies(text)[0] > 0).all()
    mass = sum(np.exp(p).sum(0) for p in model.log_p[:1]) + np.exp(model.unseen)
    assert np.allclose(mass, 1, atol=1e-5)


# --- toxicity --------------------------------------------------------------------------------------------------

def insults(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        bad = r.random() < 0.3
        words = [r.choice(WORDS["aa"]) for _ in range(r.randint(5, 80))] + (["snarfling", "grobbit"] if bad else [])
        r.shuffle(words)
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_on_unseen_texts(spark, docs):
    train, test = insults(600, 1), insults(200, 2)
    labels = spark.createDataFrame([(i, b) for i, _, b in train] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs([r[:2] for r in train]), labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs([r[:2] for r in test]), model).collect()}
    assert np.mean([found[i]["predicted"] == b for i, _, b in test]) > 0.97
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in found.values())


def test_toxicity_of_odd_texts(spark, docs, odd_texts):
    labels = spark.createDataFrame([(i, b) for i, _, b in insults(200, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs([r[:2] for r in insults(200, 1)]), labels)
    found = toxicity.score(docs(odd_texts), model)
    assert found.count() == len(odd_texts) and toxicity.score(docs([]), model).count() == 0
    assert len({r["score"] for r in found.where("doc_id in (0, 1)").collect()}) == 1
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        flat = toxicity.score(docs(odd_texts), toxicity.fit(docs([r[:2] for r in insults(200, 1)]), some))
        assert {r["predicted"] for r in flat.collect()} == {0}


# --- BPE -------------------------------------------------------------------------------------------------------

HARD = ["", "hello WORLD's don't", "a<|endoftext|>B <|startoftext|><|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "İstanbul", "éa J̌", "中文字 ١٢٣ ½²",
        "\x1c\x1d a\x85b\xa0c", "''s !'s aaaa" * 5, "a" * 300, "ab" * 200, "Ᲊ x ՘y ࢏", "\U0001f600 ok", "ſtraße ﬁ"]


def test_bpe_equals_the_library(library):
    own, r = bpe.Bpe(PATH), random.Random(1)
    texts = HARD + ["".join(r.choice("aeiouthnrs<>/w|!'12 é\nΣ") for _ in range(r.randint(1, 80))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x10000, 0x1ff00)])) for _ in range(12)) for _ in range(1500)]
    for text in texts:
        ids = [i for piece in own.encode(text) for i in piece]
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        raw, _ = own.decode(np.array(ids, np.int32), np.array([0, len(ids)]))
        assert raw.tobytes().decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_equals_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = queries.QUERIES["op5_bpe"](spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_of_odd_texts(spark, docs, odd_texts, library):
    coded = bpe.decode(bpe.encode(docs(odd_texts).withColumnRenamed("label", "ids"), PATH), PATH)
    assert coded.columns[-2:] == ["ids", "decoded"] and coded.count() == len(odd_texts)
    for r in coded.collect():
        assert list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(docs([]), PATH).count() == 0


# --- decontamination -------------------------------------------------------------------------------------------

def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(texts, items, window=10):
    wanted = defaultdict(set)
    for item, text in items:
        w = word_list(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wanted[tuple(w[i:i + n])].add(item)
    lengths = {len(k) for k in wanted}
    for doc, text in texts:
        w, hit, found = word_list(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                own = wanted.get(tuple(w[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        yield doc, len(w), sorted(hit), sorted(found)


def longest_common(a, b):
    """Words of the longest run that two lists share."""
    best, ending = 0, [0] * (len(b) + 1)
    for x in a:
        ending = [0] + [ending[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(ending))
    return best


@pytest.mark.parametrize("depth", [1, 3, 1000])
def test_suffix_array(depth):
    r = np.random.default_rng(depth)
    for n, kinds in ((0, 2), (1, 1), (300, 2), (400, 9)):
        ids = r.integers(-1, kinds, n)
        ids[n // 3:n // 2] = 0  # a long repeat
        run = np.zeros(n, int)
        for i in range(n - 1, -1, -1):
            run[i] = 0 if ids[i] < 0 else 1 + (run[i + 1] if i + 1 < n else 0)
        suffixes = decontaminate.SuffixArray(ids, run, depth)
        texts = [tuple(ids[i:i + run[i]][:depth]) for i in suffixes.at]
        assert texts == sorted(tuple(ids[i:i + run[i]][:depth]) for i in range(n) if run[i])
        wanted = r.integers(0, kinds, 50)
        for length in {1, min(2, depth), min(5, depth)}:
            starts = np.arange(50 - length)
            low, high = suffixes.find(wanted, starts, length)
            for s, a, b in zip(starts, low, high):
                assert sorted(suffixes.at[a:b]) == [i for i in range(n) if run[i] >= length and (ids[i:i + length] == wanted[s:s + length]).all()]


def planted(seed=4, n=300):
    r = random.Random(seed)
    vocabulary = ["ab", "cd", "ef", "gh", "Éa", "x1", "Z", "the", "q9"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 7, 9, 10, 11, 25, 40])))) for i in range(30)]
    items += [(30, None), (31, " - "), (32, items[0][1]), (33, "solo")]
    texts = []
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            item = r.choice(items)[1] or ""
            w = item.split()
            a = r.randrange(len(w) + 1)
            parts.append("-".join(w[a:a + r.randint(1, 30)]).upper() if r.random() < 0.3 else " ".join(w[a:a + 30]))
            parts.append(" ".join(r.choice([*vocabulary, "out", "side"]) for _ in range(r.randint(0, 12))))
        texts.append((d, "\n".join(parts)))
    return texts, items


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 400])
def test_decontamination_against_brute_force(spark, docs, part_bytes):
    texts, items = planted()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.search(docs(texts), bench, part_bytes=part_bytes).collect()
    want = {d: rest for d, *rest in brute_contamination(texts, items)}
    assert len(got) == len(want)
    for r in got:
        n_words, hit, found = want[r["doc_id"]]
        assert (r["n_words"], sorted(r["hit"]), sorted(r["items"])) == (n_words, hit, found)
        for m in r["matches"]:
            a, b = word_list(dict(items)[m["item"]]), word_list(dict(texts)[r["doc_id"]])
            same = a[m["item_word"]:m["item_word"] + m["n_words"]]
            assert len(same) == m["n_words"] and same == b[m["doc_word"]:m["doc_word"] + m["n_words"]]
            assert m["n_words"] == longest_common(a, b)
        assert sorted(m["item"] for m in r["matches"]) == found
    clean = decontaminate.keep_clean(docs(texts), bench, part_bytes=part_bytes)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, w in want.items() if not w[1])
    assert clean.columns == docs([]).columns


def test_decontamination_of_odd_texts(spark, docs, odd_texts):
    bench = spark.createDataFrame([(1, "same text here, twice over"), (2, None), (2, "word " * 50)], "item_id long, text string")
    found = rows(decontaminate.search(docs(odd_texts), bench).selectExpr("doc_id", "size(hit)"))
    assert found == sorted([(d, 5 if t and t.startswith("same") else 30_000 if d == 7 else 0) for d, t in odd_texts], key=str)
    none = decontaminate.search(docs(odd_texts), bench.limit(0))
    assert none.where("size(hit) > 0").count() == 0 and none.count() == len(odd_texts)
    assert decontaminate.search(docs([]), bench).count() == 0


# --- lines -----------------------------------------------------------------------------------------------------

def brute_lines(texts):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\f\r"))
    owner = {}
    for d, t in texts:
        for line in (t or "").split("\n"):
            k = key(line)
            if d is not None and len(k) >= 10:
                owner[k] = min(d, owner.get(k, d))
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(key(x), d) == d]
        yield d, "\n".join(kept), len(lines), len(lines) - len(kept)


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup_against_brute_force(spark, docs, batches, odd_texts):
    r = random.Random(5)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "   ", "ÄÖÜäöüßéèê", "ÄÖÜäöüßéè"]
    texts = [(d, "\n".join(r.choice(["", " ", "\t"]) + r.choice([str, str.upper])(r.choice(pool)) for _ in range(r.randint(0, 12))))
             for d in range(0, 900, 3)] + [(None, pool[0]), (12, pool[1]), (-4, pool[2])] + odd_texts
    got = line_dedup.dedup(docs(texts), batches=batches)
    assert got.columns == [*docs([]).columns, "n_lines", "n_dropped"]
    assert rows(got.select("doc_id", "text", "n_lines", "n_dropped")) == sorted(brute_lines(texts), key=str)
    assert line_dedup.dedup(docs([]), batches=batches).count() == 0


# --- token files -----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 8])
def test_segment_round_trip(bits):
    g = np.random.default_rng(2)
    for n in (0, 1, 7, 65_536, 65_537, 200_000):
        for high in (1, 2, 300, 49_408, 1 << 32):
            ids = g.integers(0, high, n, dtype=np.uint64).astype("<u4")
            body = token_files.pack_segment([3, None, -8], [n, 0, 0], ids, bits)
            doc_ids, sizes, back = token_files.unpack_segment(body)
            assert doc_ids == [3, None, -8] and list(sizes) == [n, 0, 0] and (back == ids).all()
    with pytest.raises(ValueError):
        token_files.unpack_segment(body[:-1] + bytes([body[-1] ^ 1]))


def brute_ids(texts, library):
    start = 0
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        yield d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_query(spark, sf, library):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert rows(queries.QUERIES["op10_token_files"](spark, sf)) == sorted(brute_ids(texts, library), key=str)


def test_latin_texts_are_cut_at_once(library, monkeypatch):
    """Equal to the library on random signs; no text of Latin-1 is cut by itself, no piece of a call is asked for twice."""
    r, encoder = random.Random(4), token_files.Encoder(PATH)
    signs = ["a", "B", "é", "É", "ß", "'s", "'", "'ll", "'VE", "r", "re", "v", "m", "l", "12", "½", "  ", "\n", "\t", "\x0b", "\x1c",
             "\x85", "\xa0", "-", "--", "\x00", "\x7f", "ª", "²", "µ", "<", "|", "word", "don't", "x" * 70]
    latin = ["".join(r.choices(signs, k=r.randint(0, 12))) for _ in range(3000)]
    latin = [t.replace("|", "") for t in latin]
    wide = signs + ["Σ", "İ", "\u0301", "中文", "\u2009", "\u212a", "<|endoftext|>", "\U0001f600"]
    mixed = ["".join(r.choices(wide, k=r.randint(0, 12))) for _ in range(3000)]
    for texts in (mixed, latin, [], [None, ""]):
        sizes, ids = encoder.encode(texts)
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    asked, real = [], token_files.Generation.__missing__
    monkeypatch.setattr(token_files.Generation, "__missing__", lambda self, p: asked.append(p) or real(self, p))
    monkeypatch.setattr(encoder.split, "pieces", lambda text: 1 / 0)
    encoder.known, encoder.older = token_files.Generation(), token_files.Generation()
    encoder.encode(latin)
    assert len(asked) == len(set(asked)) > 0


def test_token_files_of_odd_texts(spark, docs, odd_texts, library, tmp_path, monkeypatch):
    for texts in (odd_texts, []):
        folder = str(tmp_path / f"ids-{len(texts)}")
        token_files.write_ids(docs(texts), folder, PATH, bits=8)
        got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(bytes(r["ids"]))) for r in token_files.read_ids(spark, folder).collect()]
        assert sorted(got, key=str) == sorted(brute_ids(texts, library), key=str)
