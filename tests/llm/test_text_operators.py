"""The operators on texts against brute force, and the cases that their docstrings define."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import bitplanes, hmm, linedup, mixing, ppm, quality, simhash, spm
from barloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row bigint, id string, hash string, fp string, n bigint"
LONG = "Long words go on. " * 20_000


def odd_documents(spark):
    """Nulls, blanks, ties, repeated rows, very long texts, and columns named like inner ones."""
    texts = [None, "", " \n\t ", "one", "one two", "A b c d", "x " * 10, LONG, LONG, "été où ça", "#" * 50, "a\n\nb\n\na", "▁ ▁▁x  y"]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 2}" if i % 5 else None, 1, "k", 7, "z", "h", "f", 3) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "one two", None, None, None, None, None, None, None, None, None), (None, None, "de", "s0", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return [w for w in (text or "").encode().lower().split()]


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- SimHash


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_all_pairs(spark):
    docs = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    roots = union_find(len(docs), near)
    want = {d: (f"{fps[i]:016x}", docs[roots[i]][0]) for i, (d, _) in enumerate(docs)}
    got = QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_anchors_join_every_near_pair(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2])))
        rows.append(tuple(v - (1 << 64) if v >> 63 else v for v in (x, y)))
    df = spark.createDataFrame(rows, "x bigint, y bigint")
    got = df.select(F.arrays_overlap(simhash.anchors(F.col("x")), simhash.anchors(F.col("y"))).alias("met"), F.size(simhash.anchors(F.col("x"))).alias("n")).collect()
    assert all(r.met and r.n <= 32 for r in got)


def test_simhash_chain_and_hot_group(spark):
    chain = [(i, (1 << (i + 1)) - 1) for i in range(40)]
    near = [(100 + i, (1 << 50) | 1 << (i % 40) | 1 << (i * 7 % 40)) for i in range(300)]
    rows = [(fp, i) for i, fp in chain + near]
    distinct = {}
    for fp, i in rows:
        distinct[fp] = min(i, distinct.get(fp, i))
    df = spark.createDataFrame(list(distinct.items()), "fp bigint, rep bigint")
    from barloom.llm.common import components

    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    items = sorted(distinct.items(), key=lambda x: x[1])
    roots = union_find(len(items), [(i, j) for i in range(len(items)) for j in range(i) if (items[i][0] ^ items[j][0]).bit_count() <= 2])
    for i, (_, rep) in enumerate(items):
        assert got.get(rep, rep) == items[roots[i]][1]


def test_simhash_defined_cases(spark):
    got = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(got) == odd_documents(spark).count()
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in blank} == {0} and None in {r.doc_id for r in blank}
    assert {r.component_id for r in got if r.doc_id == 4} == {4}
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    assert simhash.near_duplicates(odd_documents(spark).limit(0)).collect() == []


# --- quality rules


def test_quality_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(SQL["op10_quality_rules"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in QUERIES["op10_quality_rules"](spark, SF).collect())
    assert got == want


def test_repeated_words_against_loops(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randrange(0, 40))) for i in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", quality.repeated_words(quality.words_of(F.col("t"))).alias("n")).collect()
    for r in got:
        w = texts[r.i].split()
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert r.n == len({k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_quality_defined_cases(spark):
    got = {r.doc_id: r for r in quality.clean_lines(odd_documents(spark)).collect()}
    assert not got[0].kept and got[0].base_failed and got[0].n_words == 0 and got[0].clean_text == ""
    assert got[11].n_dup_lines == 1 and got[5].n_words == 3 and got[10].n_symbols == 50
    assert got[7].n_repeat_words == got[7].n_words == 80_000
    assert quality.clean_lines(odd_documents(spark).limit(0)).collect() == []


@pytest.mark.parametrize(
    "line,fails",
    [
        ("This is a sentence that ends.", False), ("no end here", True), ("Home | News | Sport | Weather.", True),
        ("We use cookies on this site.", True), ("STOP IT NOW.", True), ("a### b&&& c.", True),
        ("One sentence. Another one follows here and this goes on without an end", False),
    ],
)
def test_line_rules(spark, line, fails):
    assert spark.createDataFrame([(line,)], "x string").select(quality.line_fails(F.col("x"))).first()[0] is fails


# --- language identification


def test_code_lengths_follow_the_trees_byte_by_byte(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("le chat est là", "fr"), ("the end", "en")])]
    trees = ppm.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        folded = ppm.PAD + t.encode().translate(ppm.FOLD)
        for i in range(ppm.ORDER, len(folded)):
            for k in range(ppm.ORDER + 1):
                counts[lang, folded[i - k : i]][folded[i]] += 1

    def bits(context, symbol, lang):
        here = counts[lang, context]
        lower = math.log2(ppm.S) if not context else None
        total, kinds = sum(here.values()), len(here)
        if total and symbol in here:
            return math.log2((total + kinds) / here[symbol])
        lower = lower if lower is not None else bits(context[1:], symbol, lang)
        return lower + (math.log2((total + kinds) / kinds) if total else 0)

    text = "the chat où at".encode()
    folded = ppm.PAD + text.translate(ppm.FOLD)
    want = [sum(bits(folded[i - ppm.ORDER : i], folded[i], lang) for i in range(ppm.ORDER, len(folded))) for lang in trees.langs]
    assert np.allclose(trees.code_lengths(text), want)


def test_language_query_holds_out_and_is_right(spark):
    lang = {r.doc_id: r.lang for r in documents(spark).collect()}
    got = QUERIES["op3_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_defined_cases(spark):
    got = ppm.label_documents(odd_documents(spark)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 17
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (0, 1, 2, 10))
    assert all(r.held_out is False for r in got if r.doc_id is None)
    none = ppm.label_documents(odd_documents(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert ppm.label_documents(odd_documents(spark).limit(0)).collect() == []


def test_long_text_blocks_change_nothing():
    text = ("αβγ words " * 400).encode()
    whole = np.concatenate(list(ppm.block_grams(text)))
    size, ppm.BLOCK = ppm.BLOCK, 97
    try:
        assert (np.concatenate(list(ppm.block_grams(text))) == whole).all()
    finally:
        ppm.BLOCK = size


# --- hidden Markov scores


def test_base_scores_and_counts(spark):
    docs = {r.doc_id: words(r.text) for r in documents(spark).collect()}
    train = [d for d in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    seen = Counter(w for d in train for w in docs[d])
    n, v = sum(seen.values()) + len(train), len(seen) + 1
    got = QUERIES["op9_hidden_markov_scores"](spark, SF).collect()
    for r in got:
        w = docs[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in seen for x in w) + 1, n)
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def random_model(states, seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Model(*(hmm._rows(rng.random(s)) for s in ((states,), (states, states), (states, hmm.CLASSES))))


def test_forward_and_expected_counts_against_paths():
    model = random_model(2)
    seqs = [np.array(x, np.uint16) for x in ([3, 1, 4], [hmm.END], [1, 1])]
    got = hmm.log_likelihoods(seqs, model)
    start, steps, emissions = np.zeros(2), np.zeros((2, 2)), np.zeros((hmm.CLASSES, 2))
    for seq, log10 in zip(seqs, got):
        paths = {}
        for code in range(2 ** len(seq)):
            path = [code >> t & 1 for t in range(len(seq))]
            p = model.start[path[0]] * model.emit[path[0], seq[0]]
            for t in range(1, len(seq)):
                p *= model.step[path[t - 1], path[t]] * model.emit[path[t], seq[t]]
            paths[tuple(path)] = p
        total = sum(paths.values())
        assert math.isclose(log10, math.log10(total), rel_tol=1e-12)
        for path, p in paths.items():
            start[path[0]] += p / total
            for t, s in enumerate(path):
                emissions[seq[t], s] += p / total
                if t:
                    steps[path[t - 1], s] += p / total
    for have, want in zip(hmm.expected(seqs, model), (start, steps, emissions)):
        assert np.allclose(have, want)


def test_ending_class_is_the_same_in_spark_and_python(spark):
    some = ["a", "ab", "abc", "été", "wörter", "x" * 50, "日本"]
    got = spark.createDataFrame([(w,) for w in some], "w string").select("w", hmm._ending_class(F.col("w")).alias("c")).collect()
    assert all(r.c == hmm.ending_class(r.w.encode()) for r in got)


def test_scores_of_defined_cases(spark):
    got = hmm.score(odd_documents(spark)).collect()
    assert len(got) == 17 and {r.n_tokens for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm.score(odd_documents(spark).limit(0)).collect() == []
    alone = hmm.score(odd_documents(spark).where("doc_id = 3"), modulus=1, held=0).collect()[0]
    assert alone.held_out and (alone.n_known, alone.train_tokens, alone.base_score) == (0, 0, 0.0)


# --- line dedup


def plain_line_dedup(docs, min_words):
    """Lines go that lie in a block of ``min_words`` words which any earlier document has, block by block against every document."""
    rows = {d: [x for x in ((line.strip(SPACES)) for line in (t or "").split("\n")) if x] for d, t in docs}
    before = {}
    out = {}
    for d in sorted(rows):
        b, cut = rows[d], set()
        for earlier, starts in before.items():
            a = rows[earlier]
            for j, line in enumerate(b):
                for i in starts.get(line, ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in b[j : j + n]) >= min_words:
                        cut.update(range(j, j + n))
        before[d] = {}
        for i, line in enumerate(b):
            before[d].setdefault(line, []).append(i)
        out[d] = cut
    for d, text in docs:
        kept, k = [], 0
        for line in (text or "").split("\n"):
            worded = bool(line.strip(SPACES))
            if not (worded and k in out[d]):
                kept.append(line)
            k += worded
        out[d] = (None if text is None else "\n".join(kept), len(out[d]))
    return out


def test_line_dedup_against_all_earlier_documents(spark):
    """Blocks that recur, move, cross, or have first holders of single lines elsewhere; no line is unique."""
    rng = random.Random(8)
    lines = [f"line {i} " + "word " * rng.choice([4, 12, 24]) for i in range(14)]
    blocks = [[rng.choice(lines) for _ in range(rng.randrange(2, 9))] for _ in range(6)]
    rows = []
    for d in range(150):
        text = [line for _ in range(rng.randrange(5)) for line in rng.choice([rng.choice(blocks), [rng.choice(lines)], [f"own {d} {rng.random()}"]])]
        rows.append((d, "\n".join(text)))
    got = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = plain_line_dedup(rows, linedup.MIN_WORDS)
    assert {r.doc_id: (r.text, r.deleted_lines) for r in got} == want
    assert sum(n > 0 for _, n in want.values()) > 40


def test_copies_that_patience_does_not_reach(spark):
    p = "\n".join(f"line {i} of a passage with some ten words in it" for i in range(8))
    left, right = "line a " + "word " * 30, "line b " + "word " * 30
    rows = [(1, f"s\n{p}\nt"), (2, f"t\n{p}\n{p}\ns"), (3, left), (4, right), (5, f"{left}\n{right}"), (6, f"{left}\n{right}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_key", F.lit(1)).withColumn("_cut", F.lit(2)).withColumn("deleted_lines", F.lit("x"))
    got = linedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "_key", "_cut", "deleted_lines"]
    assert {r.doc_id: r.deleted_lines for r in got.collect()} == {1: 0, 2: 16, 3: 0, 4: 0, 5: 0, 6: 2}


def test_line_dedup_query_against_pairs(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = QUERIES["op2_line_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.text, r.deleted_lines) for r in got} == plain_line_dedup(docs, linedup.MIN_WORDS)
    assert any(r.deleted_lines for r in got)


def test_patience_matches_are_equal_lines_in_order():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randrange(15))]
        b = [rng.randrange(12) for _ in range(rng.randrange(15))]
        got = linedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
    assert linedup.patience([1, 2, 3, 4], [1, 2, 3, 4]) == [(i, i) for i in range(4)]
    assert linedup.patience([9, 1, 2, 3], [1, 2, 3, 8]) == [(1, 0), (2, 1), (3, 2)]


def test_passage_moves_from_later_documents_only(spark):
    passage = "\n".join(f"line {i} of a passage with some ten words in it" for i in range(6))
    rows = [(1, "first\n" + passage + "\nend"), (2, "other\n\n" + passage + "\ntail"), (3, "alone " * 60), (2, "other\n\n" + passage + "\ntail"), (None, passage), (4, None), (5, "line 0 of a passage with some ten words in it")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("lines", F.lit(2))
    got = [(r.doc_id, r.text, r.deleted_lines) for r in linedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, rows[0][1], 0), (2, "other\n\ntail", 6), (2, "other\n\ntail", 6), (3, rows[2][1], 0), (None, "", 6), (4, None, 0), (5, rows[6][1], 0)], key=str)
    assert linedup.dedup_lines(docs).columns == ["doc_id", "text", "key", "lines", "deleted_lines"]
    assert linedup.dedup_lines(docs.limit(0)).collect() == []


# --- mixing


def test_mix_follows_the_weights(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 10 else f"small{i % 30 // 10}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_sources(docs, max_repeats=3.0, target_entropy=0.99, block_tokens=2000).collect()
    tokens, share = Counter(), {}
    for r in got:
        tokens[r.source] += r.n_tokens
        share[r.source] = r.weight
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    total = sum(tokens.values())
    for s in size:
        assert abs(tokens[s] / total - share[s]) < 0.01
        assert tokens[s] <= 3.0 * size[s] + 1e-6
        assert tokens[s] >= size[s]
    a = {s: math.log(share[s] / share["big"]) / math.log(size[s] / size["big"]) for s in size if s != "big"}
    assert max(a.values()) - min(a.values()) < 1e-6 and 0 <= min(a.values()) <= 1
    copies = Counter((r.doc_id, r.epoch) for r in got)
    assert set(copies.values()) == {1} and {r.doc_id for r in got} == set(range(3000))
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.block][r.source == "big"] += r.n_tokens
    assert all(abs(c[True] / sum(c.values()) - share["big"]) < 0.15 for c in blocks.values())


def test_mix_keeps_to_a_budget(spark):
    docs = documents(spark)
    got = mixing.mix_sources(docs, budget=20_000.0).agg(F.sum("n_tokens"), F.max("epoch")).first()
    assert got[0] <= 20_000


def test_entropy_is_met_by_bisection(spark):
    sources = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100)], "key string, tokens bigint")
    mix = mixing.choose_mix(sources, target_entropy=0.8, max_repeats=1e9)
    q = np.array([0.9, 0.09, 0.01]) ** mix.exponent
    q /= q.sum()
    assert abs(-(q * np.log(q)).sum() - 0.8 * math.log(3)) < 1e-4


def test_mix_of_defined_cases(spark):
    odd = odd_documents(spark)
    got = mixing.mix_sources(odd)
    assert got.columns == [c for c in odd.columns] + ["n_tokens", "epoch", "block", "slot", "weight"]
    ids = [r.doc_id for r in got.collect()]
    assert set(ids) == {*range(13), None}
    assert mixing.mix_sources(odd.limit(0)).collect() == []
    assert len(mixing.mix_sources(odd.where("doc_id < 3")).collect()) == 3


# --- SentencePiece


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return spm.backend(public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces_are_those_of_the_library(spark, model):
    texts = [r.text for r in odd_documents(spark).collect()] + [r.text for r in documents(spark).limit(60).collect()]
    texts += ["  a  b ", " " * 40 + "x", "日本語 😀 text", "<s> <0x0A>", "a\tb\r\nc", "ﬁ İ"]
    for text, ids in zip(texts, model.encode(texts)):
        assert ids.tolist() == (model.library.encode(text) if text else [])
        assert model.decode(ids).replace(spm.MARK, " ") == (text or "").replace(spm.MARK, " ")
    assert not model.differing


def test_tokenizers_decoder_agrees(model):
    for text in ("Some words here.", "naïve 日本 😀", " leading"):
        ids = model.encode([text])[0]
        assert model.tokenizer.decode(ids.tolist(), skip_special_tokens=False) == text


def test_unigram_models_are_rebuilt(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.unk_id, proto.trainer_spec.byte_fallback = spm.UNIGRAM, 0, True
    proto.normalizer_spec.name, proto.normalizer_spec.add_dummy_prefix = "identity", True
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = False, True
    for piece, score, kind in [("<unk>", 0, spm.UNKNOWN), *((f"<0x{b:02X}>", 0, spm.BYTE) for b in range(256)), *((p, -i - 1.0, spm.NORMAL) for i, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "c"]))]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    own = spm.Backend(str(path))
    for text in ("ab abba cab", "a", "bab  ca", "xé"):
        assert own.encode([text])[0].tolist() == own.library.encode(text)


def test_sentencepiece_query(spark):
    got = QUERIES["op5_sentencepiece"](spark, SF).collect()
    assert len(got) == 200 and all(r.round_trip and r.n_differing == 0 for r in got)
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in documents(spark).limit(50).collect():
        ids = np.array(library.encode(r.text), "<u4")
        mine = next(x for x in got if x.doc_id == r.doc_id)
        assert (mine.n_tokens, mine.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


# --- bit planes


def test_planes_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 1000, bitplanes.BLOCK):
        for top in (1, 2, 255, 256, 50_257, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (bitplanes.unpack(bitplanes.pack(ids), n) == ids).all()
    assert bitplanes.pack(np.zeros(5, "<u4")) == []


def test_bit_plane_query_against_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in documents(spark).collect()):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op7_bit_plane_output"](spark, SF).collect()) == want


def test_bit_plane_defined_cases(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = sorted(bitplanes.write_and_read(odd_documents(spark), path).collect(), key=lambda r: r.start)
    assert len(got) == 17 and got[0].doc_id is None and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    assert [r.n_tokens for r in got if r.doc_id in (0, 1)] == [1, 1]
    assert bitplanes.write_and_read(odd_documents(spark).limit(0), path).collect() == []


def test_cuts_do_not_change_ids():
    import public_tokenizers

    encoder = bitplanes.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["a", "word", " ", "  ", "\n", "\t", ".", ",", "'s", "é", "12", "²", " ", "\x1c"]) for _ in range(rng.randrange(12)))
        ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
