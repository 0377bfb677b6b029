"""Near copies by exact Jaccard similarity, against all pairs."""

import random

import corpus_pipeline
from barloom.llm import shingles
from tests.llm.test_text_operators import SF, documents, odd_documents, union_find, words

SIMILAR = 0.8


def plain_set(text):
    w = words(text)
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def plain_groups(rows):
    """{id: smallest id of its component} for (id, text)."""
    rows = sorted(rows)
    sets = [plain_set(t) for _, t in rows]

    def alike(x, y):
        return x == y or len(x & y) >= SIMILAR * len(x | y)

    roots = union_find(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    return {d: rows[roots[i]][0] for i, (d, _) in enumerate(rows)}


def edited(rng, text, edits):
    w = text.split()
    for at in rng.sample(range(len(w)), edits):
        w[at] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def made_up(rng):
    """Originals with copies a few words apart, on both sides of 0.8, and one large group of near copies."""
    word = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        text = " ".join(rng.choices(word, k=rng.choice([60, 200, 900])))
        rows += [text] + [edited(rng, text, len(text.split()) * e // 200) for e in (1, 3, 4, 5, 8)]
    hot = " ".join(rng.choices(word, k=250))
    rows += [edited(rng, hot, rng.choice([1, 3, 5])) for _ in range(300)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_drops_every_near_copy(spark):
    rows = made_up(random.Random(5))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = plain_groups(rows)
    assert sum(d != c for d, c in want.items()) > 300
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})


def test_components_against_all_pairs(spark):
    got = shingles.near_copies(documents(spark)).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_groups([(r.doc_id, r.text) for r in documents(spark).collect()])


def test_defined_cases(spark):
    odd = odd_documents(spark)
    got = shingles.near_copies(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in got if r.doc_id == 4} == {4}
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert {r.component_id for r in got if r.doc_id is None} == {0, 4}
    assert shingles.near_copies(odd.limit(0)).collect() == []


def test_simhash_proposes_first(spark):
    """The links join the classes of all pairs of fingerprints, one vote for each different five-word shingle."""
    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=1500)) for _ in range(10)]
    rows = list(enumerate([*texts, *[edited(rng, t, 1) for t in texts for _ in range(6)], "", None]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = shingles.sketches(docs, 5, id_col="doc_id", text_col="text")
    found = {r.node: r for r in marks.collect() if r.n}
    for d, text in rows[:5]:
        grams = shingles.shingles(text.encode()).tolist()
        want = sum(1 << b for b in range(64) if 2 * sum(g >> b & 1 for g in grams) > len(grams))
        assert want in {r.fp % (1 << 64) for r in found.values() if r.id == d}
    nodes = sorted(found)
    near = [(i, j) for i in range(len(nodes)) for j in range(i) if ((found[nodes[i]].fp ^ found[nodes[j]].fp) % (1 << 64)).bit_count() <= 2]
    roots = union_find(len(nodes), near)
    got = [(nodes.index(r.a), nodes.index(r.b)) for r in shingles.simhash_links(marks).collect()]
    assert union_find(len(nodes), got) == roots
    assert sum(r != i for i, r in enumerate(roots)) > 10


def test_family_of_far_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies with too many edits to be alike share keys with all others; the comparisons stay in proportion to the rows."""
    rng = random.Random(9)
    base = " ".join(rng.choices([f"w{i}" for i in range(3000)], k=150))
    rows = list(enumerate([base] + [edited(rng, base, rng.randrange(1, 8)) for _ in range(400)]))
    seen = []
    compare = shingles._Search.compare

    def counted(self, pairs):
        before = self.tried.count()
        compare(self, pairs)
        seen.append(self.tried.count() - before)

    monkeypatch.setattr(shingles._Search, "compare", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = shingles.near_copies(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_groups(rows)
    assert sum(seen) < 8 * len(rows)
