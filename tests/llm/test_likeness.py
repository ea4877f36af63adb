"""Near copies by likeness of shingles, against brute force."""

import random
import re

from ledgerloom.llm import likeness

DOCS = "doc_id long, text string"


def shingles_brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups_brute(texts):
    """{place: least place of its group} over all pairs."""
    sets, root = [shingles_brute(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.getrandbits(30)}"
    return out


def test_stage_keeps_one_of_each_group_of_likeness(spark):
    """Edited copies of 0.6 to 1, chains of them and a crowded key."""
    import corpus_pipeline

    rng, texts = random.Random(3), [None, "", " \n", "a b c", "A  b c", "a b c d"]
    for _ in range(12):
        at = [f"w{rng.getrandbits(24)}" for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(8):
            texts.append(" ".join(at))
            at = edited(rng, at, rng.randrange(0, max(2, len(at) // 28)))
    base = [f"w{rng.getrandbits(24)}" for _ in range(200)]
    texts += [" ".join(edited(rng, base, rng.randrange(1, 7))) for _ in range(60)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    want = set(groups_brute(texts))
    assert 12 < len(want) < len(texts) - 60
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want


def test_stage_on_the_test_tables(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {rows[i][0] for i in groups_brute([t for _, t in rows])}


def test_a_repeated_id_keeps_a_row_in_each_group(spark):
    a, b = "a text of some seven words here", "another text of quite other words"
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a)], DOCS)
    got = likeness.representatives(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, a), (1, a), (5, b)]


def test_crowded_keys_and_large_families_go_by_blocks(spark):
    rng = random.Random(9)
    base = [f"w{rng.getrandbits(24)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, rng.randrange(0, 8))) for _ in range(50)] + [" ".join(f"z{rng.getrandbits(24)}" for _ in range(60)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    sets = likeness.sets_of(docs)
    got = {r.node: r.root for r in likeness.components(docs, sets, bucket=6, family=900).collect()}
    names = [r.set_id for r in sets.orderBy("doc_id").collect()]
    mine, want = {}, {}
    for i, root in enumerate(groups_brute(texts)):
        want.setdefault(root, set()).add(i)
        mine.setdefault(got.get(names[i], names[i]), set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
