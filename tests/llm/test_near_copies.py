"""Near copies of the pipeline's stage against all pairs."""

import random

import pytest

import corpus_pipeline
from loadweave.llm import near_copies, simhash


def brute(texts, words=5, similarity=0.8):
    sets = [set(simhash.shingle_hashes(t.encode(), words)) if t else set() for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(i)
    return sorted(min(g, key=lambda i: (texts[i][0] is None, texts[i][0] or 0, i)) for g in groups.values())


def planted(seed=8):
    """Families of edited copies, chains among them, and a passage that most texts share."""
    r, texts = random.Random(seed), []
    word = lambda: f"w{r.randrange(5000)}"
    passage = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 8, 40, 120, 400]))] + (passage if r.random() < 0.6 else [])
        for _ in range(r.choice([1, 2, 6, 30])):
            own = list(base)
            for _ in range(r.choice([0, 1, len(own) // 60, len(own) // 40, len(own) // 25])):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
            base = own if r.random() < 0.3 else base
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("sample", [near_copies.SAMPLE, 5])
def test_near_copies_against_all_pairs(spark, docs, sample):
    texts = planted()
    kept = near_copies.keep_first(docs(texts).coalesce(1), sample=sample)
    assert kept.columns == docs([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(texts)


def test_stage_drops_near_copies(spark, docs):
    # one changed word of 80: similarity 0.88, far over two bits of a fingerprint
    words = [f"w{i}" for i in range(80)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:40], "other", *words[41:]])), (3, "a text of its own")]
    kept = corpus_pipeline.without_near_copies(spark, docs(texts), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_stage_drops_what_fingerprints_link(spark, docs):
    # a repeated phrase decides the fingerprint; of five-word shingles the sets share well under 0.8
    phrase = "one two three four five six seven eight nine ten eleven " * 200
    texts = [(5, phrase + "red green blue white black"), (2, phrase + "cat dog cow hen pig"), (9, "a text of its own"),
             (None, phrase + "cat dog cow hen pig"), (2, phrase + "oak elm ash fir yew"), (2, "another row of a repeated id")]
    prints = {simhash._fingerprints([t], 3)[0] for _, t in texts if t.startswith(phrase)}
    assert max((a ^ b).bit_count() for a in map(int, prints) for b in map(int, prints)) <= 2
    assert near_copies.keep_first(docs(texts)).count() == 5
    kept = corpus_pipeline.without_near_copies(spark, docs(texts), "").select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["text"].startswith(phrase)) for r in kept) == [(2, False), (2, True), (9, False)]


def test_chains_of_both_kinds_of_links(spark, docs):
    # 1 and 2 by fingerprint alone, 2 and 3 by similarity alone: one group
    words = [f"w{i}" for i in range(200)]
    tail = "x1 x2 x3 x4 x5 " * 2000
    first, second = tail + " ".join(words[:100]), tail + " ".join(words[100:])
    third = " ".join(["x1 x2 x3 x4 x5"] * 2 + words[100:])
    texts = [(1, first), (2, second), (3, third)]
    fp = [int(f) for f in simhash._fingerprints([t for _, t in texts], 3)]
    assert (fp[0] ^ fp[1]).bit_count() <= 2 < (fp[1] ^ fp[2]).bit_count() and brute(texts) == [0, 1]
    assert [r["doc_id"] for r in near_copies.keep_first(docs(texts), distance=2).collect()] == [1]


def test_groups_just_short_of_the_similarity_make_few_pairs(spark, docs, monkeypatch):
    """Copies of one text, each with words of its own: shingles met once fill the prefixes. By the
    counts of a small sample all prefixes held shared shingles, and pairs grew with the square of the group."""
    r, texts = random.Random(3), []
    base = [f"w{i}" for i in range(300)]
    for d in range(60):
        own = list(base)
        for at in r.sample(range(300), 12):
            own[at] = f"own{d}-{at}"
        texts.append((d, " ".join(own)))
    pairs, real = [], near_copies._similar

    def counted(found, *args):
        pairs.append(found.count())
        return real(found, *args)

    monkeypatch.setattr(near_copies, "_similar", counted)
    kept = near_copies.keep_first(docs(texts), sample=4)
    assert sorted(x["doc_id"] for x in kept.collect()) == brute(texts)
    assert len(pairs) == 2 and pairs[1] < len(texts)


def largest_join(df):
    """The most rows that a join of the plan makes; plans that adapt forget stages that lead to nothing."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plans, made = [df._jdf.queryExecution().executedPlan()], []
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
    while plans:
        plan = plans.pop()
        if "Join" in plan.getClass().getSimpleName():
            made.append(plan.metrics().apply("numOutputRows").value())
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return max(made)


def test_texts_apart_do_not_meet_in_crowded_buckets(spark, docs, monkeypatch):
    """Texts with more shingles of their own than two similar ones may have, but fewer than fill a prefix: in
    its last places they share shingles, and all components in such a bucket were joined with each other."""
    r, texts = random.Random(5), []
    base = [f"w{i}" for i in range(300)]
    for d, edits in enumerate([9] * 60 + [1] * 20):
        own = list(base)
        for at in r.sample(range(5, 295, 5), edits):
            own[at] = f"own{d}-{at}"
        texts.append((d, " ".join(own)))
    made, real = [], near_copies.materialise

    def measured(df, name, *by):
        if name == "across":
            made.append(largest_join(df))
        return real(df, name, *by)

    monkeypatch.setattr(near_copies, "materialise", measured)
    kept = sorted(x["doc_id"] for x in near_copies.keep_first(docs(texts)).collect())
    assert kept == brute(texts) == list(range(61))
    assert len(made) == 1 and made[0] < len(texts)


@pytest.mark.parametrize("similarity", [0.5, 1.0])
def test_other_similarities_against_all_pairs(spark, docs, similarity):
    texts = planted(seed=21)
    kept = near_copies.keep_first(docs(texts).coalesce(1), similarity=similarity)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute(texts, similarity=similarity)


def test_near_copies_are_rows(spark, docs, odd_texts):
    texts = [(1, "copied text of some six words"), (2, "copied text of some six words"), (2, "another text that is only here"),
             (3, "one id on two equal rows"), (3, "one id on two equal rows"), (None, "no id here at all, twice"), (None, "no id here at all, twice")]
    kept = [(r["doc_id"], r["text"]) for r in near_copies.keep_first(docs(texts)).collect()]
    assert sorted(kept, key=str) == sorted((texts[i] for i in (0, 2, 3, 5)), key=str)
    got = near_copies.keep_first(docs(odd_texts)).collect()
    assert len(got) == len(brute(odd_texts)) and near_copies.keep_first(docs([])).count() == 0


def test_rows_keep_their_numbers_when_executors_change(spark, docs, tmp_path, monkeypatch):
    """Files are cut by the default parallelism, which on a cluster follows the executors alive."""
    words = [f"w{i}" for i in range(2000)]
    r = random.Random(1)
    texts = [(i, " ".join(r.choices(words, k=30))) for i in range(40)]
    texts += [(40 + i, texts[i][1]) for i in range(10)]
    docs(texts).repartition(6).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    key, before, real = "spark.sql.leafNodeDefaultParallelism", spark.conf.get("spark.sql.leafNodeDefaultParallelism", None), near_copies._roots
    cuts = iter((1, 64))

    def changed(links):
        spark.conf.set(key, next(cuts))
        return real(links)

    monkeypatch.setattr(near_copies, "_roots", changed)
    try:
        kept = near_copies.keep_first(stored)
        spark.conf.set(key, 7)
        assert sorted(x["doc_id"] for x in kept.collect()) == list(range(40))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
