"""The training-data operators against brute force, round trips and edge cases."""

import gzip
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, run
from pyspark.sql import functions as F

from tapescope.llm import chat, decontam, neardup, packing, pii, quality, queries, sharding, tokencount, toxicity, warc
from tapescope.llm.common import ready

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, score string, spans int"  # extra columns with clashing names
ODD = [(1, None, "x", "y", 1), (2, "", None, None, None), (2, "", None, None, None), (None, "a b c d e f", "x", "y", 1), (3, "word " * 60_000, "x", "y", 1),
       (4, "The same words again and again.\n" * 3, "x", "y", 1), (5, "The same words again and again.\n" * 3, "x", "y", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    ready(spark)
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    _, _, error = run(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert error is None, error


# ---- 1 toxicity

def test_toxicity_learns_held_out_rows(spark):
    ready(spark)
    rnd = random.Random(1)
    plain = ["river", "stone", "cloud", "maple", "table", "window", "garden", "paper", "letter", "music"]
    rows, labels = [], []
    for i in range(600):
        words, toxic = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))], i % 5 == 2
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(["gronk", "GRONK!", "blarg", "bl4rg"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.fit(docs, marks).scored(docs).select("row.doc_id", "score").collect()
    held = [(r["score"], labels[r["doc_id"]][1]) for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert held and all(0 <= s <= 1 for s, _ in held)
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.95


def test_toxicity_odd_rows(odd, none, spark):
    model = toxicity.fit(odd, spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int"))
    got = model.scored(odd)
    assert got.count() == len(ODD) and got.select("row.*").columns == odd.columns
    assert {r["score"] for r in got.collect()} != {None}
    assert model.scored(none).count() == 0
    lexicon = toxicity.Lexicon({"gronk": 3.0, "blar*": 2.0})
    assert lexicon.features(None) == lexicon.features("") == [0.0] * len(toxicity.FEATURES)
    assert lexicon.of("bl4rgs!")[0] == 2.0 and lexicon.of("gronk,")[0] == 3.0 and lexicon.of("stone")[0] == 0.0


# ---- 2 personal data

def brute_base(text):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(digits) <= 19 and doubled % 10 == 0
                    or k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_against_brute_force():
    rnd = random.Random(3)
    for _ in range(5000):
        text = "".join(rnd.choice("a@.1 +-(2_b9é") for _ in range(rnd.randint(0, 40)))
        assert pii.identifiers(text) == brute_base(text), text
        assert pii.all_spans(text)[0] == brute_base(text)


@pytest.mark.parametrize("text, kind, span", [
    ("mail bob.x [at] mail dot example dot com now", "email", "bob.x [at] mail dot example dot com"),
    ("bоb@ex.com", "email", "bоb@ex.com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111"),
    ("at 10 dot 0 dot 0 dot 1 now", "ip", "10 dot 0 dot 0 dot 1"),
])
def test_pii_disguises_map_to_source(text, kind, span):
    base, spans = pii.all_spans(text)
    assert set(base) <= set(spans)
    assert (kind, span) in [(pii.KINDS[k], text[s:e]) for s, k, e in spans]


@pytest.mark.parametrize("text, span", [
    ("ring plus 1 415 555 0100 now", "plus 1 415 555 0100"),
    ("call +1 415 five 55 0 one 23 now", "+1 415 five 55 0 one 23"),
    ("ring +1 415 ſix 55 0100 now", "+1 415 ſix 55 0100"),
])
def test_pii_disguises_need_no_other_disguise(text, span):
    assert ("phone", span) in [(pii.KINDS[k], text[s:e]) for s, k, e in pii.all_spans(text)[1]]
    assert pii.redact(text) == text.replace(span, "[PHONE]")


def test_pii_spans_do_not_depend_on_unrelated_disguises():
    rnd = random.Random(5)
    pieces = ["plus ", "+", "1 ", "415 ", "555", "0100 ", "five ", "one ", "_two ", "ſix ", "bob", " at ", "@", "ex", " dot ", ".", "com ", "(at)", "[dot] ", "10", "é ", ". ", "&#64;", "\u200b", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 16)))
        opened = text + "\n\n[ dot ]"  # a disguise that touches nothing else
        assert pii.all_spans(text)[1] == pii.all_spans(opened)[1], text


def test_pii_long_runs_are_linear():
    for text in ("1" * 200_000, "a." * 100_000, "1.1." * 50_000, "one " * 50_000, "@" * 100_000, "+1 " * 60_000, " " * 200_000 + "dot"):
        pii.all_spans(text)


def test_pii_odd_rows(odd, none):
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    kept = pii.redacted(odd, length=None)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert pii.redact("write to a@b.co or 1.2.3.4") == "write to [EMAIL] or [IP]" and pii.redact(None) is None


# ---- 3 near duplicates

def brute_groups(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(30):  # chains of edits: neighbours are similar, the ends are not
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 6, 12, 60, 200]))]
        for _ in range(rnd.randint(1, 8)):
            rows.append((len(rows), " ".join(words)))
            if rnd.random() < 0.8:
                words = list(words)
                for _ in range(max(1, len(words) // 30)):
                    words[rnd.randrange(len(words))] = rnd.choice(vocab)
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    ready(spark)
    rows = near_copies()
    got = neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k, percent=80).collect()
    want = brute_groups(rows, k, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def family(n, seed=9):
    """Altered copies of one text, a third of whose pairs are linked, and some small families."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.choice([2, 6, 10, 14, 30])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(words)))
    for f in range(20):
        words = [f"f{f}_{j}" for j in range(60)]
        for _ in range(3):
            words[rnd.randrange(60)] = "odd"
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("limits", [(8192, 4_000_000), (40, 4_000_000), (8192, 9_000)])
def test_near_duplicates_of_a_large_family(spark, limits):
    """The family in one block, and in many by number and by weight."""
    ready(spark)
    rows = family(240)
    got = neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2, percent=80, limits=limits).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(rows, 2, 80)


def test_links_of_a_task_are_a_spanning_forest():
    """No more links than sets, whatever the number of pairs; groups joined before are not compared."""
    sets = [neardup.shingle_set(t, 2) for _, t in family(300)]
    regs = np.stack([neardup.registers(s) for s in sets])
    found = neardup.spanning(np.arange(len(sets)), sets, regs, 80)
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert len(pairs) > 2000 > len(sets) > len(found)
    assert neardup.spanning(np.zeros(len(sets)), sets, regs, 80) == []
    assert all((a, b) in set(pairs) or (b, a) in set(pairs) for a, b in found)


def test_banding_recall_at_the_threshold():
    """Share of pairs at 0.8 to 0.85 that meet in a band and pass the estimate, over 3,000 pairs."""
    rng, met, n = np.random.default_rng(8), 0, 0
    for size in (40, 145, 600):
        for _ in range(1000):
            shared = int(np.ceil(2 * size * rng.uniform(0.8, 0.85) / (1 + 0.8)))
            every = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            a, b = np.sort(every[:size]), np.sort(every[size - shared:])
            if 100 * shared < 80 * len(every):
                continue
            ra, rb = neardup.registers(a), neardup.registers(b)
            keys = neardup.band_keys(np.stack([ra, rb]))
            passed = neardup.estimated(ra[None], rb[None])[0] >= 0.8 - neardup.margin(np.array([size]), 0.8)[0]
            met, n = met + bool(passed and (keys[0] == keys[1]).any()), n + 1
    assert n > 2000 and met == n


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(1)
    for n, shared in ((2000, 1800), (300, 200), (12, 11)):
        draws = [rnd.integers(0, 2**63, 2 * n - shared, dtype=np.uint64) for _ in range(20)]
        est = [neardup.estimated(neardup.registers(np.sort(x[:n]))[None], neardup.registers(np.sort(x[n - shared:]))[None])[0] for x in draws]
        assert abs(np.mean(est) - shared / (2 * n - shared)) < 0.06


def test_near_duplicates_odd_rows(odd, none):
    got = neardup.grouped(odd, shingle=2).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert all(r["n_shingles"] == 0 and r["kept"] for r in got if r["doc_id"] in (1, 2))
    assert neardup.grouped(none).count() == 0


# ---- 4 decontamination

def test_wu_manber_against_brute_force(spark):
    ready(spark)
    rnd = random.Random(5)
    words = "a b c d e é1".split()
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 5, 9])))) for i in range(8)]
    docs = [(i, "?".join(rnd.choice(words).upper() for _ in range(rnd.randint(0, 60)))) for i in range(60)]
    want = {}
    for d, text in docs:
        w, hit, seen = [x.encode().lower().decode() for x in text.split("?") if x], set(), set()
        for i, item in items:
            p = item.split()
            m = min(4, len(p))
            for s in range(len(p) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at:at + m] == p[s:s + m]:
                        hit |= set(range(at, at + m))
                        seen.add(str(i))
        want[d] = (len(w), hit, sorted(seen))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 20):  # one block, several blocks
        got = by_id(decontam.find_hits(spark.createDataFrame(docs, "doc_id long, text string"), bench, window=4, block_bytes=block))
        assert {d: (r["n_words"], {x for h in r["hits"] for x in range(h["start"], h["end"])}, r["items"]) for d, r in got.items()} == want
    clean = {r["doc_id"] for r in decontam.without_hits(spark.createDataFrame(docs, "doc_id long, text string"), bench, 4, 20).collect()}
    assert clean == {d for d, (_, h, _) in want.items() if not h}


def test_decontamination_odd_rows(odd, none, spark):
    bench = spark.createDataFrame([(None, "again and again"), (7, None), (8, ""), (9, "word word"), (9, "again and again")], "item_id long, text string")
    got = decontam.find_hits(odd, bench).collect()
    assert len(got) == len(ODD)
    assert {tuple(r["items"]) for r in got if r["doc_id"] in (3, 4, 5)} == {("9",)} and all(r["n_words"] == 0 for r in got if r["doc_id"] in (1, 2))
    assert decontam.find_hits(none, bench).count() == 0 and sum(r["n_words"] for r in decontam.find_hits(odd, bench.limit(0)).collect()) > 60_000


# ---- 5 token counts

def test_edits_equal_full_recount():
    count, rnd = tokencount.counter(tokencount.vocabulary_path()), random.Random(2)
    alphabet = ["a", "b", " ", "\n", "'", "l", "s", "1", "é", "!", "  ", "ll", "the ", "\t"]
    for turn in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4000 if turn % 40 == 0 else 30)))
        tree = tokencount.Tree(*count.split(text))
        for _ in range(5):
            at, delete, insert = rnd.randint(-1, len(text) + 2), rnd.randint(0, 6), "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4)))
            text = tree.edit(text, at, delete, insert, count)
            assert tree.tokens[1] == len(count.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)
            assert [p for leaf in tree.leaves for p in leaf] == list(zip(*count.split(text)))


def test_edit_touches_only_its_surroundings():
    count = tokencount.counter(tokencount.vocabulary_path())
    text = "some words here " * 20_000
    tree = tokencount.Tree(*count.split(text))
    tree.edit(text, 100_000, 3, "new", count)
    assert tree.reencoded < 10


def test_token_counts_odd_rows(odd, none):
    edits = F.array(F.struct(F.lit(None).cast("int").alias("at"), F.lit(10**6).alias("delete"), F.lit("x y").alias("insert")))
    got = tokencount.edited(tokencount.build(odd).withColumn("edits", edits)).collect()
    assert len(got) == len(ODD) and {r["text"] for r in got} == {"x y"} and len({r["n_tokens_after"] for r in got}) == 1
    assert tokencount.edited(tokencount.build(none).withColumn("edits", F.lit(None).cast("array<struct<at:int,delete:int,insert:string>>"))).count() == 0


# ---- 6 sharding

def test_matrix_has_exact_margins_and_fair_cells():
    rng = np.random.default_rng(0)
    cells = []
    for _ in range(300):
        m = np.array(sharding.communication_matrix([30, 50, 20], [34, 33, 33], rng))
        assert m.sum(axis=1).tolist() == [30, 50, 20] and m.sum(axis=0).tolist() == [34, 33, 33] and (m >= 0).all()
        cells.append(m[1, 0])
    assert abs(np.mean(cells) - 17) < 0.6 and abs(np.var(cells) - 50 * 0.34 * 0.66 * 50 / 99) < 1.2
    assert abs(sharding.hypergeometric(10**11, 10**11, 10**10, rng) - 5 * 10**9) < 10**6


def test_shards_are_exact_and_gapless(spark, odd, none):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shuffle_into(rows, shards=24, bucket_rows=40).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in got) == list(range(1003)) and {len(s) for s in slots.values()} == {41, 42}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_into(sharding.sized(odd), 3).count() == len(ODD) and sharding.shuffle_into(sharding.sized(none), 3).count() == 0
    assert sharding.shuffle_into(odd.withColumn("shard", F.lit("clash")), 2).where("shard in (0, 1)").count() == len(ODD)


# ---- 7 chat

def test_chat_windows_round_trip(spark):
    rnd = random.Random(4)
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant", None, "a\nb"])
            rows.append((c if c else None, t, role, rnd.choice([None, "", "</s>[INST] ok [/INST]", "<|turn|>user\n&lt; <|end|>\n", "word " * rnd.randint(1, 300)]), "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(df)
    turns, targets = defaultdict(list), defaultdict(list)
    for r in sorted(chat.parsed(made).collect(), key=lambda r: (r["conv_id"] or 0, r["window"])):
        turns[r["conv_id"]] += [(t["role"], t["text"]) for t in r["turns"]]
        targets[r["conv_id"]] += r["targets"]
    want = defaultdict(list)
    for c, _, role, text, _ in rows:
        want[c].append((role or "", text or ""))
    assert turns == want
    assert targets == {c: [t for r, t in v if r == "assistant"] for c, v in want.items()}
    repeated = made.where("n_context > 0").collect()
    assert repeated and made.where("window > 1").count() > 0
    assert chat.windows(df.limit(0)).count() == 0


@pytest.mark.parametrize("prompt", ["rule " * 10, "rule " * 400, "規" * 250, "規" * 300, "rule " * 2_000])
def test_chat_windows_repeat_any_system_turn(spark, prompt):
    turns = [(1, 0, "system", prompt)] + [(1, t, "user" if t % 2 else "assistant", f"turn{t} " * (60 if t % 5 else 5)) for t in range(1, 31)]
    made = sorted(chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r["window"])
    sizes = {t: len(text.split()) if " " in text else len(text) for _, t, _, text in turns}
    assert len(made) > 1 and [r["window"] for r in made] == list(range(1, len(made) + 1))
    for r in made:
        assert r["formatted"].startswith(f"<|turn|>system\n{prompt}<|end|>\n") and (r["window"] == 1 or r["n_context"] > 0)
        held = [0, *(int(m) for m in re.findall(r"<\|turn\|>(?:user|assistant)\nturn([0-9]+)", r["formatted"]))]
        own = held[max(1, r["n_context"]):]
        assert sum(sizes[t] + chat.MARKS for t in held) <= chat.BUDGET or len(own) == 1
    assert sum(len(r["loss"]) for r in made) == 15


# ---- 8 packing

def test_pack_is_gapless_and_tight(spark, odd, none):
    docs = spark.createDataFrame([(i, "river stone " * (i * 7 % 900)) for i in range(300)] + [(None, None), (5, "")], "doc_id long, text string")
    got = packing.pack(packing.tokenize(docs)).collect()
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(seqs) <= 1.03 * total / 2048 + 2
    assert packing.pack(packing.tokenize(none)).count() == 0 and packing.pack(packing.tokenize(odd)).where("doc_id = 2 and length = 1").count() == 2


def test_words_encode_like_whole_texts():
    enc, rnd = packing.WordEncoder(packing.tokenizer_path()), random.Random(6)
    parts = ["The", "the,", "IDIOT", "l'été", "isn't", "a..b", ".", ",,", "É́", " ", "\x1c", "\x85", " ", "\n", "  ", "x1y2", "ﬁne", "Σας", "<|endoftext|>", "日本", "I'LL", "é,", "word.", "Éàç", "ÇÀ.", "straße", "ÿÞ", "e\u0301t"]
    for _ in range(500):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", "\t"]) for _ in range(rnd.randint(0, 12)))
        want = enc.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.text(text), "<u4").tolist() == want, repr(text)


def test_patterns_hold_demand_exactly():
    rng = np.random.default_rng(2)
    for n in (1, 7, 400):
        sizes, demand = np.unique(rng.integers(1, 65, n), return_counts=True)
        patterns = packing.solve_patterns(sizes, demand.astype(float), 64)
        assert (sum(a * k for a, k in patterns) == demand).all() and all((a * sizes).sum() <= 64 for a, _ in patterns)
        assert sum(k for _, k in patterns) <= 1.1 * (sizes * demand).sum() / 64 + 1
    assert packing.solve_patterns(np.array([], int), np.array([]), 64) == []


def test_patterns_with_many_pivots_end_beside_a_session(spark, monkeypatch):
    """More than 100 classes and more than 400 pivots: the basis is inverted anew in a driver that holds a session."""
    rng, seen = np.random.default_rng(4), []
    invert = packing.inverted
    monkeypatch.setattr(packing, "inverted", lambda a: seen.append(len(a)) or invert(a))
    sizes, demand = np.arange(1, 257), rng.integers(1, 4000, 256).astype(float)
    assert spark.range(10).count() == 10
    patterns = packing.solve_patterns(sizes, demand, 256)
    assert seen and min(seen) > 100
    assert (sum(a * k for a, k in patterns) == demand).all() and all((a * sizes).sum() <= 256 for a, _ in patterns)
    a = rng.random((120, 120))
    assert np.abs((invert(a)[:, :, None] * a[None]).sum(axis=1) - np.eye(120)).max() < 1e-8


def test_pack_query_against_a_plain_encoding(spark, tmp_path):
    texts = [(1, "The river, the STONE and the river."), (2, None), (3, "word " * 5000), (4, "l'\u00e9t\u00e9 2048 \U0001f600 " * 700), (5, "The river, the STONE and the river.")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = packing.WordEncoder(packing.tokenizer_path()).tokenizer
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts}
    got, held = queries.op8(spark, str(tmp_path)).collect(), defaultdict(list)
    for r in got:
        ids = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["doc_tokens"] == len(want[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        held[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert sum(r["length"] for r in got) == sum(map(len, want.values()))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


# ---- 9 WARC

def record(payload, kind="response", page=1):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return (b"WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
            % (kind.encode(), page, warc.sha1_base32(payload).encode(), len(body)) + body + b"\r\n\r\n")


def test_salvage_recovers_later_records():
    a, b, c = record(b"one\r\n\r\nWARC/1.1\r\nx"), record(b"two", page=2), record(b"three", page=3)
    assert [x[0] for x in warc.salvage(a + b + c)] == ["record"] * 3
    for broken, lost in ((b.replace(b"two", b"twa"), b), (b[:-20], b[:-20]), (b.replace(b"Content-Length: ", b"Content-Length: 9"), b), (b"junk" + b, b"junk")):
        got = list(warc.salvage(a + broken + c))
        pages = [x[3]["warc-record-id"] for x in got if x[0] == "record"]
        assert pages[0] == "<urn:page:1>" and pages[-1] == "<urn:page:3>"
        gap = next(x for x in got if x[0] == "gap")
        assert gap[1] == len(a) and gap[3]
        assert sum(e - s for _, s, e, _, _ in got) == len(a + broken + c)
    zipped = gzip.compress(a) + gzip.compress(b)[:-9] + gzip.compress(c)
    got = list(warc.salvage(zipped))
    assert [x[0] for x in got] == ["record", "gap", "record"] and got[-1][3]["warc-record-id"] == "<urn:page:3>"
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"nothing here")] == ["gap"]


def test_salvage_inside_a_member_of_many_records():
    rnd = random.Random(6)
    parts = [record(bytes(rnd.choice(b"abcdefgh ") for _ in range(3000)), page=i) for i in range(40)]
    whole, after = b"".join(parts), record(b"after", page=99)
    pages = lambda got: [int(x[3]["warc-record-id"][10:-1]) for x in got if x[0] == "record"]
    damaged = parts[:7] + [parts[7][:-50] + b"?" + parts[7][-49:]] + parts[8:]
    packed = gzip.compress(b"".join(damaged))
    got = list(warc.salvage(packed + gzip.compress(after)))
    assert pages(got) == [*range(7), *range(8, 40), 99]
    gaps = [x for x in got if x[0] == "gap"]
    at = sum(map(len, parts[:7]))
    assert [(x[1], x[2]) for x in gaps] == [(0, len(packed))] and gaps[0][3].endswith(f"(inflated bytes {at} to {at + len(parts[7])})")
    for level in (0, 6):  # stored and packed
        packed = gzip.compress(whole, level)
        flipped = bytearray(packed)
        flipped[-6] ^= 1  # checksum: all records are there
        got = list(warc.salvage(bytes(flipped) + gzip.compress(after)))
        assert pages(got) == [*range(40), 99] and [x[3] for x in got if x[0] == "gap"][0].startswith("gzip member")
        for cut in (1, 8, 9, len(packed) // 3, len(packed) // 2):
            for tail in (b"", gzip.compress(after), after):
                got = list(warc.salvage(packed[:-cut] + tail))
                kept = pages(got)
                assert kept[-1:] == [99] or not tail
                kept = kept[:-1] if tail else kept
                assert kept == [*range(len(kept))] and len(kept) >= 39 - 40 * cut // len(packed) - 1
                assert any(x[0] == "gap" and x[3].startswith("gzip member") for x in got)
    packed = gzip.compress(whole)
    for where in range(1000, len(packed), len(packed) // 9):
        broken = bytearray(packed)
        broken[where:where + 40] = bytes(40)
        kept = pages(warc.salvage(bytes(broken) + gzip.compress(after)))
        assert kept[-1] == 99 and kept == sorted(set(kept)) and len(kept) >= where * 40 // len(packed) - 1


@pytest.mark.parametrize("broadcast", [True, False])
def test_warc_round_trip(spark, tmp_path, monkeypatch, broadcast):
    ready(spark)
    if not broadcast:
        monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    rows = [(1, "http://a b\r\n", "same"), (9, None, "same"), (4, "u", "same"), (5, "u", None), (6, "u", ""), (7, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "lone"), (8, "u", "x" * 300_000), (8, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, size string")
    warc.write(pages, str(tmp_path / "w"), archive_bytes=100_000)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(rows)
    types = sorted((r["record_id"], r["record_type"], r["refers_to"]) for r in got)
    assert ("<urn:page:1>", "revisit", "<urn:page:9>") in types and ("<urn:page:5>", "revisit", "<urn:page:6>") in types and ("<urn:page:9>", "response", None) in types
    for r in got:
        if r["record_type"] == "response":
            assert r["digest"] == "sha1:" + warc.sha1_base32(bytes(r["payload"])) and r["http_length"] == len(r["payload"])
    assert sorted(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response" and r["record_id"] in ("<urn:page:7>", "<urn:page:9>")) == ["same", "é\r\n\r\nWARC/1.1\r\n"]
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0


# ---- 10 quality

def brute_quality(text):
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text or "") if w]
    grams, cover = defaultdict(list), set()
    for i in range(len(words) - 4):
        grams[tuple(words[i:i + 5])].append(i)
    for at in grams.values():
        if len(at) > 1:
            for i in at:
                cover |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t\n\x0b\x0c\r]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)


def test_quality_against_brute_force(spark, odd, none):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["a", "b", "é", " ", "\n", "#", "\x0b", "\x85"]) for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    got = by_id(quality.judged(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, text in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(text), repr(text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    got = quality.judged(odd).collect()
    assert len(got) == len(ODD) and {r["n_repeat_words"] for r in got if r["doc_id"] == 3} == {60_000} and quality.judged(none).count() == 0


# ---- pipeline

def test_pipeline_stages(spark, odd, none, tmp_path):
    import corpus_pipeline as pipeline

    clean = " ".join(f"the plain{i} of words" for i in range(40))
    passage = " ".join(f"item{i}" for i in range(14))
    rows = [(1, clean, 9), (2, clean + " tail", 9), (3, clean, 9), (4, "Start " + passage + " end. " + " ".join(f"q{i}" for i in range(30)), 9),
            (5, "write to bob@example.com " + " ".join(f"z{i}" for i in range(30)), 9), (None, "no id", 9)]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("score", F.lit("clash"))
    for i, (name, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, none.withColumn("n_chars", F.lit(1)), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert i == len(pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            assert {r["doc_id"] for r in docs.collect()} == {1, 4, 5, None}
        if name == "decontamination":
            assert {r["doc_id"] for r in docs.collect()} == {1, 5, None}
        if name == "pii":
            assert by_id(docs)[5]["text"].startswith("write to [EMAIL] z0") and by_id(docs)[5]["n_chars"] == len(by_id(docs)[5]["text"])
    assert {r["doc_id"] for r in docs.collect()} == {1, 5, None}


@pytest.mark.parametrize("labels", [[], [(10_000 + i, i % 2) for i in range(50)], [(i, 1) for i in range(50)], [(i, 0) for i in range(50)], [(1, 1)],
                                    [(i, int(zlib.crc32(str(i).encode()) % 5 != 4 or i % 2)) for i in range(50)]])
def test_pipeline_keeps_documents_without_a_classifier(spark, tmp_path, labels):
    """No label, none of these documents, one class, one label, one class in folds 1 to 3 only."""
    import corpus_pipeline as pipeline

    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, f"a clean text {i}", "x") for i in range(50)] + [(None, None, "x")], "doc_id long, text string, score string")
    with pytest.warns(UserWarning, match="no document is rejected"):
        out = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 51


def test_op_queries_cover_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_toxicity", "op2_pii", "op5_edit_counts", "op6_sharding"):
        assert queries.QUERIES[name](spark, SF).count() == n
    packed = queries.QUERIES["op8_packing"](spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(packed) == n and all(r["n"] == r["t"] for r in packed)
    row = next(r for r in queries.QUERIES["op2_pii"](spark, SF).collect() if r["spans"])
    base = pii.identifiers(spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == row["doc_id"]).first()["text"])
    assert row["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
