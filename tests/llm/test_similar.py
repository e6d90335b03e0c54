"""Near-duplicates by similarity: components against brute force."""

from __future__ import annotations

import random

from brookmart.llm import simhash


def brute(docs: list[tuple[int, str]], similarity: float = 0.8) -> dict[int, int]:
    """Component of every document that has a neighbour of the similarity."""
    def shingles(t: str) -> set[str]:
        w = t.split()
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in docs}
    at = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) and at[a] != at[b]:
                low, high = sorted((at[a], at[b]))
                at = {i: low if c == high else c for i, c in at.items()}
    many = list(at.values())
    return {i: c for i, c in at.items() if many.count(c) > 1}


def found(spark, docs: list[tuple[int, str]]) -> dict[int, int]:
    return {r.id: r.component for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}


def test_crowded_lists_lose_no_pair(spark):
    """Interleaved ids, a boilerplate that all texts share, and groups whose hub, which alone is near the others, has
    neither the smallest id nor a near one."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(9000)}"
    shared = [word() for _ in range(110)]
    docs, groups = [], 60
    for g in range(groups):
        own = [word() for _ in range(50)]
        hub = shared + own
        docs.append((g + 2 * groups, " ".join(hub)))
        for k, (s, e) in enumerate(((112, 128), (130, 146), (147, 160), (20, 36))):  # each is near the hub only
            docs.append((g + (k + (k > 1)) * groups, " ".join([*hub[:s], *(word() for _ in range(e - s)), *hub[e:]])))
    want = brute(docs)
    assert len(set(want.values())) >= groups // 2
    assert found(spark, docs) == want


def test_short_texts_equal_brute_force(spark):
    """Texts of 5 to 20 words, many exactly at the similarity: 4 of 5 shingles, 12 of 15."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for _ in range(150):
        base = [word() for _ in range(rng.randint(5, 20))]
        forms = [base, base[:-1], [*base, word()], base[1:], [*base[:-1], word()], [word(), *base[1:]]]
        docs += [" ".join(f) for f in rng.sample(forms, 3)]
    rng.shuffle(docs)
    docs = [*enumerate(docs), (9000, ""), (9001, "one"), (9002, "two words"), (9003, "two words")]
    want = brute(docs)
    assert len(want) > 100 and 9003 in want
    assert found(spark, docs) == want


def lists_of(spark, docs: list[tuple[int, str]], frequent=None):
    """(shingle lists, texts) of distinct texts."""
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = simhash._wide(df, "doc_id", "text", 5, 4, 0.8).withColumnRenamed("doc_id", "id")
    return simhash.shingle_lists(rows.where("size > 0")), df.withColumnRenamed("doc_id", "id")


def test_candidates_of_a_large_group_are_linear(spark, tmp_path):
    """5,000 copies of one text with up to four shingles in ten changed: about as many pairs as members, all links kept."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    docs = []
    for k in range(5000):
        share = 0.4 * k / 5000
        docs.append((k, " ".join(f"x{rng.randrange(10**9)}" if rng.random() < share / 5 else w for w in base)))
    met, texts = lists_of(spark, docs)
    met.write.parquet(str(tmp_path / "met"))
    met = spark.read.parquet(str(tmp_path / "met"))
    star = simhash.stars(met, 0.8).distinct()
    assert 1000 < star.count() < 4 * 5000
    links = simhash._verified(simhash._enough(star, met, 0.8), texts, 5, 0.8)
    more = simhash.rest(met, simhash.components(links), 0.8)
    assert more.count() < 4 * 5000


def test_a_list_of_unrelated_texts_loses_no_pair(spark):
    """500 texts that share a frequent passage and, by twos, more or less of the rest: every band of similarity is kept."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    docs = []
    for k in range(0, 500, 2):
        own = [word() for _ in range(60)]
        other = list(own)
        for spot in rng.sample(range(60), rng.randint(0, 5)):
            other[spot] = word()
        docs += [(k, " ".join(passage + own)), (k + 1, " ".join(passage + other))]
    want = brute(docs)
    assert 100 < len(want) < 500
    assert found(spark, docs) == want


def test_lists_in_parts_give_the_same_links(spark, monkeypatch):
    """A frequent shingle's list is kept in parts; their hubs meet, and the rest is compared over all parts."""
    rng = random.Random(15)
    word = lambda: f"w{rng.randrange(5000)}"
    docs = []
    for g in range(6):
        base = [word() for _ in range(60)]
        for k in range(40):
            docs.append((g * 40 + k, " ".join(word() if rng.random() < 0.03 else w for w in base)))
    monkeypatch.setattr(simhash.rarest, "__defaults__", (0, 5))
    h = simhash.np.unique(simhash.shingle_hashes(docs[0][1].encode(), 5))
    keys = simhash.rarest(h, 0.8, h, simhash.np.full(len(h), 40))
    assert (keys & simhash.SALT).min() >= 1
    assert found(spark, docs) == brute(docs)
