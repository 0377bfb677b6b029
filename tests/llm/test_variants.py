"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from barloom.llm import variants
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_words(rows, misspelt=199):
    found = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if misspelt and h % misspelt == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            found[w] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def plain_variants(counts):
    near = {w: [] for w in counts}
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[:i]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def answer(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_query_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert answer(QUERIES["op12_spelling_variants"](spark, SF)) == plain_variants(plain_words(rows))


def test_chains_of_forms_and_few_letters(spark):
    """Words over few letters, so that nearly all share reduced words; counts that make chains of forms."""
    rng = random.Random(5)
    words, n = {}, 5
    word = "abcdefg"
    for k in range(6):
        words[word] = n
        n *= 5
        at = rng.randrange(len(word))
        word = word[:at] + "xyz"[k % 3] + word[at + (k % 2) :]
    for _ in range(300):
        words["".join(rng.choices("abé", k=rng.choice([6, 7, 7, 8])))] = rng.choice([5, 6, 30, 200])
    words["z" * 5000] = 5
    words["z" * 4999] = 5
    words["z" * 5000 + "a"] = 30
    texts = [" ".join([w] * k) for w, k in words.items()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, word string")
    got = answer(variants.spelling_variants(docs))
    assert got == plain_variants(plain_words(enumerate(texts), None))
    assert max(len({w, root}) for w, (_, root, *_) in got.items()) == 2
    assert any(got[w][1] != got[w][0] and got[w][0] is not None for w in words if w in got)


def test_numbers_of_neighbourhoods():
    rng = np.random.default_rng(1)
    for length in (1, 2, 6, 40):
        digits = rng.integers(0, 5, (20, length))
        shorter, changed = variants.neighbourhood(digits, 5)
        for row, less, other in zip(digits, shorter, changed):
            if length > 1:
                want = {int(variants.reduced_numbers(np.delete(row, i)[None])[0]) for i in range(length)}
                assert set(less.tolist()) == want
            want = set()
            for i in range(length):
                for s in range(5):
                    if s != row[i]:
                        edited = row.copy()
                        edited[i] = s
                        want.add(int(variants.reduced_numbers(edited[None])[0]))
            assert set(other.tolist()) == want


def test_defined_cases(spark):
    rows = [(None, "Letters letters LETTERS"), (1, None), (2, ""), (3, "letter5letter letter-letter× letter"), (3, "letters letters Жletters"), (4, "Étoile " * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = answer(variants.spelling_variants(docs))
    assert got == {"letters": (None, "letters", 6, 0, None), "Étoile": (None, "Étoile", 5, 0, None)}
    assert variants.spelling_variants(docs.limit(0)).collect() == []
