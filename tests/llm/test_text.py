import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchcraft.llm import bpe, kneser, langid, lines, packing, quality, token_counts
from patchcraft.llm.words import UNPLAIN, WordEncoder, is_plain

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def key(x):
    return tuple((v is None, v) for v in x)


def measures(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    ls = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(ls), len(ls) - len(set(ls)), len(covered)


def test_ledger_against_brute_force(llm, docs, corpus):
    odd = ["a b c a b c a", "x y\nx y\n\n \nx y", "# | <b> A B", "w " * 5000, "p q r p q r s p q r"]
    more = docs.select("doc_id", "text").union(llm.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = [r[:2] for r in corpus] + [(1000 + i, t) for i, t in enumerate(odd)]
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    entries = quality.ledger(more)
    assert sorted((tuple(r) for r in entries.select(cols).collect()), key=key) == sorted(((i, *measures(t)) for i, t in texts), key=key)
    names = [r.name for r in quality.RULES]
    for r in entries.collect():
        m = r.asDict() | {"true": True}
        for i, rule in enumerate(quality.RULES):
            assert bool(r["failures"] >> i & 1) == bool(eval(rule.fails, {}, m)), (names[i], r)


def test_ablations_are_what_policies_say(docs):
    entries = quality.ledger(docs).cache()
    rows = entries.collect()
    found = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablations(entries, "full-1").collect()}
    for i, rule in enumerate(quality.RULES):
        assert found[rule.name] == (sum(r["failures"] >> i & 1 for r in rows), sum(r["failures"] == 1 << i for r in rows))
    assert entries.where(quality.passes("base-1")).count() == sum(r["failures"] & 3 == 0 for r in rows)
    assert all(r["n_failed"] == 0 for r in quality.ablations(entries.limit(0), "base-1").collect())


def test_line_dedup_on_small_sites(llm):
    def page(lines_):
        return "<html><script>if (a<b) x();</script><body>" + "".join(f"<p>{x}</p>" for x in lines_) + "</body></html>"

    rows = [(i, f"https://User@Site.example:80/{i}", page(["menu", f"own {i}", "twice" if i < 2 else "-"]), "x") for i in range(10)]
    rows += [(20, "http://one.example/", page(["menu", "menu"]), None), (21, None, None, None), (22, "", "", None), (23, "no url", "a<br/>b", None), (None, "http://one.example/2", page(["x"]), "n")]
    got = {(r["page_id"], r["host"]): (r["n_lines"], r["n_dropped"], r["text"]) for r in lines.line_dedup(llm.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[(0, "site.example")] == (3, 1, "own 0\ntwice")
    assert got[(5, "site.example")] == (3, 2, "own 5")
    assert got[(20, "one.example")] == (2, 0, "menu\nmenu")
    assert got[(21, "")] == got[(22, "")] == (0, 0, "") and got[(23, "")] == (2, 0, "a\nb") and got[(None, "one.example")] == (1, 0, "x")
    assert lines.line_dedup(llm.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing_holds_every_piece_once(docs, corpus, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.pack_documents(docs, WORDS, capacity=64, slack=2, leaf_pieces=20, fan_in=2).collect()
    want = Counter()
    for doc_id, text, *_ in corpus:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want[doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.05 * sum(r["length"] for r in got) / 64 + 2
    assert packing.pack_documents(empty, WORDS).count() == 0


def test_best_fit_prefers_the_fullest_bin():
    assert packing.best_fit([5, 6, 4, 3, 2], 10) == [[1, 2], [0, 3, 4]]
    assert packing.best_fit([], 10) == [] and packing.best_fit([10, 10], 10) == [[0], [1]]


ODD = ["", " ", "  a  b \n c\n\n", "it's  we'll\t\n x", "<|endoftext|>hi<|endoftext|>", "日本語 ñ́ x\xa0y\x85z", "a" * 300, "\n\nfoo \nbar ", "x\x1cy \x1f z", "İ ﬁ Σς ẞ", "😀 ok", "¼²ªº «q»"]


def fuzz(n, alphabet=" \n\tab'sé1.<|", seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_word_encoder_is_the_library():
    ours, library = WordEncoder(WORDS), Tokenizer.from_file(WORDS)
    for t in [*ODD, *fuzz(400), *fuzz(200, "ABé <|startofx>'")]:
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_byte_encoder_with_and_without_a_lexicon_is_the_library(tmp_path):
    library, vocabulary = Tokenizer.from_file(BYTES), bpe.Vocabulary(BYTES)
    texts = [*ODD, *fuzz(500)]
    words = sorted({w.encode() for t in texts[::2] for w in bpe.pre_tokens(t)})
    file = tmp_path / "lexicon"
    file.write_bytes(bpe.compile_transducer(words, [vocabulary.merge(w) for w in words]))
    mapped = bpe.Transducer(str(file))
    assert all(mapped.get(w) == vocabulary.merge(w) for w in words) and mapped.get(b"") is None and mapped.get(words[0] + b"\xff") is None
    for coder in (bpe.Encoder(BYTES, str(file)), bpe.Encoder(BYTES)):
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(coder.encode(t), "<u4").tolist() == ids, t
            assert coder.decode(coder.encode(t)) == library.decode(ids, skip_special_tokens=False)


def test_transducer_shares_suffixes():
    words = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing"))
    states = np.frombuffer(bpe.compile_transducer(words, [[1]] * len(words))[:28], np.int32)[3]
    assert states < 20  # a tree would have over 30


def test_pre_tokens_are_counted_as_whole_texts_are_split(spark):
    texts = [*ODD, *fuzz(300), *fuzz(100, " \n\ta'"), "\x01a b", "\x01", "a \x01b", "a <|b", "a  b", "a\n b", "a b ", "a b\n", "a \n\tb c", None]
    counted = bpe.count_pre_tokens(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = Counter(w.encode() for t in texts for w in bpe.pre_tokens(t or ""))
    assert {bytes(r["word"]): r["n"] for r in counted.collect()} == want
    assert "lambda" not in counted._jdf.queryExecution().optimizedPlan().toString()  # a function called for each part
    for t in filter(None, texts):
        raw = t.encode()
        assert is_plain(t, raw) == (not UNPLAIN.search(t)) and bpe._is_even(raw) == (not bpe._UNEVEN.search(t)), t
    coder = bpe.Encoder(BYTES)
    assert coder.decode(b"") == "" and coder.decode(coder.encode("é")[:4]) == bpe.Vocabulary(BYTES).text[int.from_bytes(coder.encode("é")[:4], "little")].decode("utf-8", "replace")


def test_encode_documents(docs, corpus, empty):
    library = Tokenizer.from_file(BYTES)
    ids = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in corpus}
    coded = bpe.encode_documents(docs, BYTES, most=64).cache()
    for r in coded.collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["doc_id"]] and r["n_tokens"] == len(ids[r["doc_id"]])
    texts = {r[0]: r[1] or "" for r in corpus}
    assert all(r["text"] == texts[r["doc_id"]] for r in bpe.decode_documents(coded, BYTES).collect())
    for r in bpe.encode_documents(docs, BYTES, digest=True).collect():
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_documents(empty, BYTES, digest=True).count() == 0


def test_edits_count_as_the_whole_text_does():
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    count, rng = token_counts.TokenCounter(BYTES), random.Random(9)
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in [*ODD, *fuzz(600)]:
        tree = token_counts.TokenTree.build(t, count, leaf=6)
        assert tree.n_tokens == size(t)
        for _ in range(5):
            a = rng.randint(0, len(t))
            b = min(len(t), a + rng.choice([0, 0, 1, 3, 30]))
            new = "".join(rng.choice([*" \nab's1", "'", "r", "e", "v", "l", "ll", "'re", "'ve", "t", "m", "d"]) for _ in range(rng.choice([0, 1, 1, 2, 6])))
            after, _ = tree.edit(t, a, b, new, count)
            assert after == t[:a] + new + t[b:] and sum(tree.chars[tree.width :]) == len(after)
            assert tree.n_tokens == size(after), (t, a, b, new)
            t = after


def test_an_edit_may_complete_a_contraction_that_began_in_the_leaf_before():
    library, count = Tokenizer.from_file(BYTES), token_counts.TokenCounter(BYTES)
    for tail, new in (("rx", "e"), ("vx", "e"), ("lx", "l"), ("x", "s"), ("x", "t")):
        for left in range(1, 14):
            text = "a" * left + "'" + tail + " and more of it"
            for leaf in (1, 4, 8):
                tree, at = token_counts.TokenTree.build(text, count, leaf), left + len(tail)
                after, _ = tree.edit(text, at, at + 1, new, count)
                assert tree.n_tokens == len(library.encode(after, add_special_tokens=False).ids), (after, leaf)


def test_stored_trees_go_on_where_they_ended(llm, docs, empty):
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    cut = lambda a, b, new: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"), F.lit(new).alias("new")))
    long = llm.createDataFrame([(1, "the quick brown fox. " * 4000)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(long)
    first = token_counts.count_with_edits(rows, cut(5, 9, " it's"), BYTES, keep_text=True).cache()
    again = token_counts.count_with_edits(first, cut(40_000, 40_001, "'re"), BYTES, leaves=("leaf_chars", "leaf_tokens"), keep_text=True).cache()
    got = again.collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(r["n_tokens_edited"] for r in first.collect())
    for r in got:
        assert r["n_tokens_edited"] == len(library.encode(r["text"], add_special_tokens=False).ids) and sum(r["leaf_chars"]) == len(r["text"])
    # A tree that is not the text's is not used.
    wrong = first.withColumn("leaf_chars", F.array(F.lit(1)))
    assert [r["n_tokens"] for r in token_counts.count_with_edits(wrong, cut(0, 0, ""), BYTES, leaves=("leaf_chars", "leaf_tokens")).orderBy("doc_id", "n_tokens").collect()] == [
        r["n_tokens"] for r in again.orderBy("doc_id", "n_tokens").collect()
    ]
    assert token_counts.count_with_edits(first.limit(0), cut(0, 0, ""), BYTES, leaves=("leaf_chars", "leaf_tokens")).count() == 0


def test_caches_stay_bounded_and_keep_what_comes_often():
    made = []
    cache = token_counts.Cache(lambda k: made.append(k) or k + 1, most=10)
    for i in range(500):
        assert cache.get(7) == 8 and cache.get(1000 + i) == 1001 + i
        assert len(cache.now) <= 10 and len(cache.old) <= 10
    assert made.count(7) == 1


def test_edits_read_little_of_a_long_text(llm, docs, empty):
    count, text = token_counts.TokenCounter(BYTES), "the quick brown fox. " * 5000
    tree = token_counts.TokenTree.build(text, count)
    _, read = tree.edit(text, 50_000, 50_003, "slow", count)
    assert read < 2000
    edits = F.array(F.struct(F.lit(-5).alias("start"), F.lit(2).alias("stop"), F.lit(None).cast("string").alias("new")), F.struct(F.lit(9**9).alias("start"), F.lit(None).cast("int").alias("stop"), F.lit("z").alias("new")))
    rows = token_counts.count_with_edits(docs, edits, BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        assert r["n_tokens_edited"] == len(library.encode(texts[r["doc_id"]][2:] + "z", add_special_tokens=False).ids)
    assert token_counts.count_with_edits(docs, F.lit(None), BYTES).where("n_edits > 0").count() == 0
    assert token_counts.count_with_edits(empty, edits, BYTES).count() == 0


def test_kneser_ney_probabilities_add_up(llm):
    rng = random.Random(1)
    letters = "abc .é日"
    counts = Counter(t[i : i + 3] for t in ("".join(rng.choice(letters) for _ in range(60)) for _ in range(30)) for i in range(58))
    counted = llm.createDataFrame(list(counts.items()), "gram string, c long").cache()
    contexts = {g[:2] for g in counts}
    asked = llm.createDataFrame([(c + x,) for c in contexts for x in letters], "gram string")
    table = kneser.probabilities(counted, asked, order=3, alphabet=len(letters)).collect()
    sums = defaultdict(float)
    for r in table:
        sums[r["gram"][:2]] += 2 ** -r["bits"]
    assert set(sums) == contexts and all(abs(p - 1) < 1e-6 for p in sums.values())


def _cross_entropy(trusted, text, order=4):
    """Interpolated modified Kneser-Ney from its definition, one character after the other."""
    lead = chr(kneser.BEFORE) * (order - 1)
    counts = {order: Counter((lead + t)[i : i + order] for t in trusted for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [0] + [sum(v == k for v in c.values()) for k in range(1, 5)]
        if not (n[1] and n[2]):
            return [0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k], kneser.LEAST_DISCOUNT), float(k)) if n[k] else 0.5 * k for k in (1, 2, 3)]

    off = {k: discounts(counts[k]) for k in counts}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            after[k][g[:-1]].append(v)

    def p(g):
        k = len(g)
        if not k:
            return 1 / kneser.CODE_POINTS
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        c = counts[k].get(g, 0)
        less = off[k][min(c, 3) - 1] if c else 0
        return (max(c - less, 0) + sum(off[k][min(v, 3) - 1] for v in seen) * p(g[1:])) / sum(seen)

    return -sum(math.log2(p((lead + text)[i : i + order])) for i in range(len(text))) / len(text) if text else None


def test_perplexity_against_the_definition(llm, monkeypatch):
    monkeypatch.setattr(kneser, "BLOCK_CHARS", 700)
    rng = random.Random(11)
    text = lambda: "".join(rng.choice("aaab cé日\n\0😀") for _ in range(rng.randint(0, 250)))
    rows = [(i, text(), "xx") for i in range(40)] + [(40, None, None), (41, "", "xx"), (None, "aab", "xx"), (3, "other", None), (42, "aab " * 600, "xx")]
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(3, 1, None), (4, 0, 0), (6, 1, 1), (None, 1, 0)]
    good = {i for i, *_ in labels if i is not None} - {4, 6}
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = kneser.quality_classifier(docs, llm.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    trusted = [t or "" for i, t, _ in rows if i in good]
    want = Counter((i, lang or "und", len(t or ""), i in good) for i, t, lang in rows)
    assert Counter((r["doc_id"], r["lang"], r["n_chars"], r["trusted"]) for r in got) == want
    expected = {(i, len(t or "")): _cross_entropy(trusted, t or "") for i, t, _ in rows}
    for r in got:
        e = expected[r["doc_id"], r["n_chars"]]
        assert (r["perplexity"] is None) if e is None else abs(math.log2(r["perplexity"]) - e) < 1e-5


def test_texts_stay_in_their_buckets(llm):
    """Nothing but what is said of a block is exchanged to meet it."""
    docs = llm.createDataFrame([(i, i, "xx", "some text") for i in range(50)], "doc_id long, key long, lang string, text string")
    name = f"kneser_test_{uuid.uuid4().hex}"
    found = kneser.blocks(docs, name)
    flags = llm.createDataFrame([(0, 0)], "of long, at int")
    plan = kneser.packed_grams(found, flags)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "hashpartitioning(of#" in plan and "Bucketed: true" in plan
    llm.sql(f"DROP TABLE {name}")


def test_quality_classifier_tells_junk_from_trusted_text(llm, empty):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(100)) + "."
    rows = [(i, prose(), "xx", False) for i in range(200)]
    rows += [(1000 + i, re.sub(" ", "### ", prose()).upper(), "xx", True) for i in range(20)]
    rows += [(2000, None, "xx", None), (2001, "", None, None), (None, prose(), None, None), (3, rows[3][1], "xx", True)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    labels = llm.createDataFrame([(i, 1, 0) for i in range(150)] + [(5, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = kneser.quality_classifier(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] for r in got if r["doc_id"] is None or r["doc_id"] < 1000 or r["doc_id"] >= 2000)
    assert not any(r["kept"] for r in got if r["doc_id"] and 1000 <= r["doc_id"] < 1020)
    assert sum(r["trusted"] for r in got) == 149
    assert kneser.quality_classifier(empty, labels).count() == 0
    assert kneser.quality_classifier(docs, labels.limit(0)).where("not kept").count() == 0


def test_language_id_on_held_out_rows(llm, empty):
    rng = random.Random(3)
    sylls = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["eau", "que", "oi", "é"]}
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(sylls[k]) for _ in range(30)), k, "s") for i, k in enumerate(sorted(sylls) * 120)]
    rows += [(5000, None, "aa", "s"), (5001, "123 !!", "bb", "s"), (5002, "kato mira", None, "s"), (None, "verung eisch ung", None, None), (1, rows[1][1], rows[1][2], "s")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.language_id(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in rows[:360] if by[r[0]]["held_out"]]
    assert len(held) > 40 and sum(by[r[0]]["lang_pred"] == r[2] for r in held) > 0.97 * len(held)
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (5000, 5001))
    assert by[5002]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got)
    assert langid.language_id(empty).count() == 0
    assert {r["lang_pred"] for r in langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_temperature_lowers_overconfident_scores():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(500, 3)) * 5
    y = np.array([rng.choice(3, p=langid.softmax(s / 5)) for s in scores])
    assert 3 < langid.fit_temperature(scores, y) < 8


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_quality_classifier", "op9_language_id"])
def test_queries_cover_whole_tables(llm, name):
    from patchcraft.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES[name](llm, sf).count() == llm.read.parquet(f"{sf}/documents.parquet").count()


def test_scrambled_letters_of_any_script_score_worse(llm):
    rng = random.Random(6)
    letters = "абвгдежзиклмнопрстуя"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(80)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(100))
    scramble = lambda t: re.sub(r"\w", lambda _: rng.choice(letters), t)
    rows = [(i, prose(), "ru") for i in range(120)] + [(1000 + i, scramble(prose()), "ru") for i in range(20)]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = llm.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kneser.quality_classifier(docs, labels).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in kept if i >= 1000)


def test_local_grams_are_those_of_each_text():
    for texts in (["abcab", "", "日本x", "a"], [], [""], ["".join(map(chr, range(32, 0xD000))), "ab"]):
        grams, places = kneser.local_grams(texts, 4)
        padded = [chr(kneser.BEFORE) * 3 + t for t in texts]
        grams = ["".join(map(chr, g)) for g in grams.tolist()]
        assert grams == sorted(grams)
        assert [grams[i] for i in places] == [p[i : i + 4] for p, t in zip(padded, texts) for i in range(len(t))]
        assert len(grams) == len(set(grams))


def test_language_sample_is_bounded_whatever_the_ids(llm):
    rows = llm.range(0, 6000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    numbered = langid._numbered(rows)
    assert numbered.select("number").distinct().count() > 5900
    small = numbered.select("number", "lang", F.lit(b"").alias("at"), F.lit(b"").alias("value"))
    want = {lang: sorted(r["number"] for r in small.collect() if r["lang"] == lang)[:50] for lang in "ab"}
    got = langid._least(small, 50).collect()
    assert {lang: sorted(r["number"] for r in got if r["lang"] == lang) for lang in "ab"} == want


def test_packing_hands_up_a_bounded_number_of_bins(llm):
    """Pieces of which no two fit together: each partition but hands up a few, and none is put off to the root."""
    rng = random.Random(6)
    rows = [(i, 0, 0, rng.randint(2100, 4000), i) for i in range(3000)] + [(None, 0, 0, 1, 5)] * 1500
    pieces = llm.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(4)
    read = []
    real = packing.written
    packing.written = lambda df, name: read.append(real(df, name)) or read[-1]
    try:
        got = packing.pack(real(pieces, "pieces"), leaf_pieces=300, fan_in=4).collect()
    finally:
        packing.written = real
    assert len(got) == len(rows)
    first, *later = read
    assert first.groupBy("part").count().agg(F.max("count")).first()[0] < 600  # equal rows spread too
    bins = lambda df: df.select("part", "origin", "bin").distinct().groupBy("part").count().agg(F.max("count")).first()[0]
    assert all(bins(df.where("sequence_id < 0")) <= 5 for df in [first, *later[:-1]])
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) == 3000  # every long piece has its own sequence, the short ones fill them
