"""Operators 4, 6, 8, 9 and 10 against brute force, round trips and held-out accuracy, with awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, langid, mixing, registry, secrets, winnow

ODD = [
    (1, "a b c token = \"abcdef0123456789abcdef0123\" x", "en", "s1", 5),
    (1, "a b c token = \"abcdef0123456789abcdef0123\" x", "en", "s1", 5),
    (2, None, None, None, None),
    (3, "", "en", None, 0),
    (None, "word " * 5000, "fr", "s2", 1),
    (4, "12 34 !!", "en", "s2", 1),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows=ODD, clash=True):
    d = spark.createDataFrame(rows, DOCS)
    return d.selectExpr("*", "1 AS score", "'x' AS row", "2 AS size", "'y' AS spans") if clash else d


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 4
def plain_winnow(data, k, w):
    import numpy as np

    if not data:
        return []
    k = min(k, len(data))
    h = [int(winnow._rolling(np.frombuffer(data[i : i + k], np.uint8), k)[0]) for i in range(len(data) - k + 1)]
    h = [int(winnow.mix(np.array([x], np.uint64))[0]) >> 32 for x in h]
    w, out = min(w, len(h)), []
    for i in range(len(h) - w + 1):
        j = max(range(i, i + w), key=lambda j: (-h[j], j))
        if not out or out[-1] != (h[j], j):
            out.append((h[j], j))
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 20), st.integers(1, 9))
def test_winnow_is_the_definition(data, k, w):
    h, p = winnow.winnow(data, k, w)
    assert list(zip(h.tolist(), p.tolist(), strict=True)) == plain_winnow(data, k, w)


def test_next_documents(spark, data):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    ids = sorted(rows)
    got = {r["doc_id"]: r for r in registry.QUERIES["op4_winnow_fingerprints"](spark, data).collect()}
    assert sorted(got) == ids
    far = near = 0

    def alike(a, b):  # by the fingerprints that the query shows
        a, b = (set(x.split(",")) - {""} for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, d in enumerate(ids):
        text, nxt = rows[d], rows[ids[(i + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == winnow.text_of(winnow.winnow(text.encode())[0])
        assert r["edited_fingerprint"] == winnow.text_of(winnow.winnow(edited.encode())[0])
        assert r["near_edited"] == pytest.approx(alike(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(alike(r["fingerprint"], got[ids[(i + 1) % len(ids)]]["fingerprint"]))
        far, near = far + (r["near_edited"] <= r["near_next"]), near + 1
    assert far / near < 0.05


def test_ranges_wrap_in_many_parts(spark):
    rows = [(i * 7 % 600, f"text number {i} " * (i % 4), "en", "s", 0) for i in range(600)]
    parts = defaultdict(lambda: ([], []))
    for r in winnow.by_range(docs(spark, rows), bytes_a_range=2000).collect():
        parts[r["part"]][r["ahead"]].append(r["doc_id"])
    ranges = sorted(parts.values())
    assert sum((own for own, _ in ranges), []) == list(range(600)) and len(ranges) > 4
    assert [ahead for _, ahead in ranges] == [[own[0]] for own, _ in ranges[1:]] + [[0]]


def test_long_text_and_equal_ids(spark):
    rows = [(1, "ab" * 60_000 + "c" * 40_000, "en", "s", 0), (1, "x" * 30, "en", "s", 0), (1, "x" * 30, "en", "s", 0), (None, "y", "en", "s", 0)]
    got = winnow.compare_with_next(docs(spark, rows)).collect()
    assert sorted(r["n_chars"] for r in got) == [1, 30, 30, 160_000]
    assert {r["near_next"] for r in got if r["n_chars"] == 30} == {0.0, 1.0}
    assert winnow.compare_with_next(docs(spark, [(None, "a", None, None, None)] * 2)).count() == 2


def test_odd_rows_fingerprint(spark):
    assert winnow.compare_with_next(docs(spark)).count() == len(ODD)
    assert winnow.compare_with_next(docs(spark, [])).count() == 0
    assert {r["fingerprint"] for r in winnow.fingerprints(docs(spark)).where("doc_id in (2, 3)").collect()} == {""}


# --- 6
def plain_secrets(text):
    text = text or ""
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, e, k in sorted(out, key=lambda x: (x[0], x[2]))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_Key", "apikey", "paſſword", "K", "secret", '"', " ", "=", ":", "abcdef", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef", "é", "x.y", "ABC123"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    assert sorted((s, e, k) for s, e, k, _ in secrets.find(text)) == sorted(plain_secrets(text))


def test_secret_scan(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_secret_scan"](spark, data).collect()}
    assert len(got) == len(rows)
    for r in rows:
        base = plain_secrets(r["text"])
        told = [f"{secrets.KINDS[k]}:{s}:{e}" for s, e, k in base]
        g = got[r["doc_id"]]
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(k == j for *_, k in base) for j in range(3))
        assert g["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(g["spans"].split(",")) or not told


def test_ownership_separates(spark):
    live, copied = "Zq8x7Kp2Lm9Rt4Vb6Nw3", "Ex4mpl3K3yEx4mpl3K3y1"
    rows = [(i, f"see {copied} here", "en", f"s{i}", 0) for i in range(5)] + [(9, f"see {live} here", "en", "s1", 0)]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_scan(docs(spark, rows)).collect()}
    assert got[9] == "live:4:24" and not any(got[i] for i in range(5))


def test_owners_and_repositories_differ(spark):
    one, forks, shared = "Aa11Bb22Cc33Dd44Ee55", "Ff66Gg77Hh88Ii99Jj00", "Kk12Ll34Mm56Nn78Oo90"
    rows = [(i, f"a {one} b" if i == 0 else f"a {forks} b" if i < 5 else f"a {shared} b", "r%d" % i, "o%d" % (i if i >= 5 else 0), 0) for i in range(9)]
    d = docs(spark, rows)
    told = lambda **k: {r["doc_id"] for r in secrets.secret_scan(d, repo_col="lang", owner_col="source", **k).collect() if r["n_live"]}
    assert told() == {0} and told(most_repositories=4) == {0, 1, 2, 3, 4} and told(most_owners=4, most_repositories=4) == set(range(9))


def test_a_long_text_of_secrets_takes_linear_time():
    import time

    text = "token = abcdefgh12 Zq8x7Kp2Lm9Rt4Vb6Nw3 " * 100_000
    began = time.time()
    base = secrets.find(text)
    assert len(base) == 100_000 and len(secrets.candidates(text, base)) == 100_000 and time.time() - began < 5


def test_candidates_beside_base_spans():
    text = "AKIA" + "A1" * 10 + "x" * 30 + "1234 z9z9z9z9z9z9z9z9z9z9z9z9 token=abcdef0123456789abcdef0123"
    base = secrets.find(text)
    want = [m.span() for m in secrets.LONG.finditer(text) if not any(s < m.end() and m.start() < e for s, e, *_ in base)]
    assert [(s, e) for s, e, *_ in secrets.candidates(text, base)] == want and len(want) == 1


def test_odd_rows_secrets(spark):
    got = secrets.secret_scan(docs(spark)).collect()
    assert len(got) == len(ODD) and sorted(r["n_assign"] for r in got) == [0, 0, 0, 0, 1, 1]
    assert secrets.secret_scan(docs(spark, [])).count() == 0


# --- 8
def test_language_held_out(spark, data):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op8_language_id"](spark, data).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    score, counts, first = rng.normal(0, 5, (11, 3)).astype(np.float32), np.array([6, 1, 4]), np.array([0, 6, 7])
    got = langid._viterbi(score, first, counts, 4.0)
    for f, n in zip(first, counts, strict=True):
        value = lambda path: sum(score[f + i, k] for i, k in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        assert value(got[f : f + n]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=int(n))), abs=1e-3)


def test_mixed_spans_and_scripts(spark):
    en, ru = "the house and the garden with the other ", "дом и сад большой город где "
    rows = [(i, (en if i % 2 else ru) * 3, "en" if i % 2 else "ru", "s", 0) for i in range(20)]
    model = langid.train(docs(spark, rows))
    out = langid.identify(docs(spark, [(1, en + ru, None, "s", 0), (2, None, None, "s", 0), (3, "123 …", None, "s", 0)]), model, spans=True).orderBy("doc_id").collect()
    assert [s["lang"] for s in out[0]["lang_spans"]] == ["en", "ru"] and out[0]["lang_spans"][1]["start"] == len(en)
    assert [(r["lang_pred"], r["score"]) for r in out[1:]] == [("und", 0.0)] * 2 and not isinstance(out[0]["score"], int)


def plain_grams(word):
    """Slots of a word's trigrams, the end included."""
    cp = [0, 0] + [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word] + [0]
    mask = 2**64 - 1
    for i in range(2, len(cp)):
        a, b, c = cp[i], cp[i - 1], cp[i - 2] if cp[i - 1] else 0
        yield ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & mask) >> 40 & (langid.SLOTS - 1)


def plain_words(text):
    import itertools
    import unicodedata

    letter = lambda c: unicodedata.category(c)[0] == "L"
    return ["".join(g) for k, g in itertools.groupby(text or "", letter) if k]


def plain_language(train, texts, penalty=langid.PENALTY):
    """Predictions by dictionaries, one word after the other; the scripts of these texts narrow nothing."""
    import math

    counts = {}
    for text, lang in train:
        mine = counts.setdefault(lang, defaultdict(int))
        for w in plain_words(text):
            for g in plain_grams(w):
                mine[g] += 1
    total = {k: sum(c.values()) + 0.5 * langid.SLOTS for k, c in counts.items()}
    names = sorted(counts)
    for text in texts:
        words_, best, back = plain_words(text), dict.fromkeys(names, 0.0), []
        for w in words_:
            grams = list(plain_grams(w))
            top = max(names, key=lambda k: best[k])
            came = {k: k if best[k] >= best[top] - penalty else top for k in names}
            best = {k: best[came[k]] - penalty * (came[k] != k) + sum(math.log((counts[k].get(g, 0) + 0.5) / total[k]) for g in grams) for k in names}
            back.append(came)
        now, share = max(names, key=lambda k: best[k]), dict.fromkeys(names, 0)
        for w, came in zip(reversed(words_), reversed(back), strict=True):
            share[now] += len(w)
            now = came[now]
        if not words_:
            yield "und", 0.0
            continue
        top = max(names, key=lambda k: share[k])
        yield top, share[top] / sum(share.values())


def test_query_against_dictionaries(spark, data):
    rows = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    train = [(r["text"], r["lang"]) for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    want = list(plain_language(train, [r["text"] for r in rows]))
    got = sorted(registry.QUERIES["op8_language_id"](spark, data).collect(), key=lambda r: r["doc_id"])
    assert [r["lang_pred"] for r in got] == [k for k, _ in want]
    assert sum(abs(r["score"] - s) < 0.02 for r, (_, s) in zip(got, want, strict=True)) >= 0.99 * len(got)  # sums in single precision


def test_every_letter_is_one():
    import sys
    import unicodedata

    letter, *_ = langid._tables()
    assert all(letter[c] == (unicodedata.category(chr(c))[0] == "L") for c in range(sys.maxunicode + 1))


def test_repeated_and_long_texts(spark):
    rows = [(i, "the house and the garden " * 3, "en", "s", 0) for i in range(6)] + [(9, "das haus und der garten " * 3, "de", "s", 0)]
    model = langid.train(docs(spark, rows))
    d = docs(spark, [(1, "the garden", None, "s", 0)] * 2 + [(None, "das haus " * 40_000, None, None, None), (4, "\U000323af", "x", "s", 0)])
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(d, model).collect()), key=str)
    assert got[:2] == [(1, "en", 1.0)] * 2 and got[2][1] in ("de", "en") and got[3] == (None, "de", 1.0)


def test_no_language_learned(spark):
    model = langid.train(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs(spark), model).collect()} == {"und"}


# --- 9
def test_targets_are_water_filled():
    got = {s: t for s, _, t in mixing.targets([("a", 10), ("b", 100), (None, 50)])}
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(240) and got[None] <= 100 and got["b"] <= 200
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [("a", 0, 0.0)]


def plain_targets(totals, weights=(5, 2, 1), share=1.5, most=2.0):
    """Pours the words out in small steps of equal height by weight, none above its cap."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    w, left = [weights[i % len(weights)] for i in range(len(order))], share * sum(n for _, n in order)
    cap, level = [most * n for _, n in order], 0.0
    lo, hi = 0.0, 2 * left + 1
    for _ in range(200):  # the height at which just all is poured
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(c, k * level) for c, k in zip(cap, w, strict=True)) < left else (lo, level)
    return {s: min(c, k * level) for (s, _), c, k in zip(order, cap, w, strict=True)}


def test_draws_keep_the_quota_at_any_number_of_groups(spark):
    import numpy as np

    quota = np.array([900, 0, 17, 4000], np.int64)
    for most in (1, 40, 10_000):
        got = mixing.groups(quota, slots_a_shard=13, most_draws=most)
        assert np.array([g[4] for g in got]).sum(0).tolist() == quota.tolist() and sum(g[2] for g in got) == -(-4917 // 13)
        plan = spark.createDataFrame(got, "grp long, begin long, shards long, first array<long>, drawn array<long>")
        rows = mixing.slots(plan, [450, 0, 9, 2000], 4917, -(-4917 // 13)).collect()
        shards = defaultdict(list)
        for r in rows:
            shards[r["shard"]].append(r["slot"])
        assert len(rows) == 4917 and all(sorted(v) == list(range(len(v))) and 12 <= len(v) <= 13 for v in shards.values())
        for sid, n in ((0, 450), (2, 9), (3, 2000)):  # each block twice at most, after every block came once
            times = defaultdict(int)
            for r in rows:
                times[r["block"]] += r["sid"] == sid
            assert max(times.values()) <= 2 and len([b for b in times if times[b]]) == min(n, int(quota[sid]))


def test_mix(spark, data):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    one, two = (sorted(registry.QUERIES["op9_mix_sources"](spark, data).collect(), key=lambda r: r["doc_id"]) for _ in range(2))
    assert one == two and [r["doc_id"] for r in one] == sorted(rows)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in one:
        s = rows[r["doc_id"]]["source"]
        assert r["size"] == len(words(rows[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    for s in taken:
        assert abs(taken[s] - target[s]) <= 64 + 0.02 * target[s]
    assert target == pytest.approx(plain_targets(list(size.items())), rel=1e-6)


def test_mixed_blocks_agree_with_counts(spark):
    rows = [(i, f"w{i} " * (i * 7 % 90), "en", f"s{i % 3}" if i % 5 else None, 0) for i in range(60)]
    d = docs(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()}
    blocks = defaultdict(int)
    for r in mixing.mixed_blocks(d).collect():
        assert set(words(r["text"])) == {f"w{r['doc_id']}"}
        blocks[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(blocks)


def test_odd_rows_mix(spark):
    got = mixing.mix(docs(spark)).collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_permutation_is_one():
    import numpy as np

    from tessera.llm.common import permute

    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(permute(np.arange(n), n, 5).tolist()) == list(range(n))


# --- 10
T = chat.Template()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*T.control, "<", "[", "\\", "/", "|", "s>", "INST]", "é", "turn|>", "x"]), max_size=10).map("".join))
def test_escape_round_trip(text):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text and not any(c in escaped for c in T.control)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), st.sampled_from(["", "ok", "<|end|>", "<|turn|>x", "<|en", "a<|text|>"])), max_size=5), st.integers(1, 9))
def test_output_is_read_as_one_text(turns, size):
    """Wherever the output is cut, the turns are the same."""
    whole = "".join(T.turn + T.escape(r) + T.text + T.escape(t) + T.end for r, t in turns)
    reader = chat._Reader()
    for k in range(0, len(whole), size):
        reader.feed(whole[k : k + size], False, True, T)
    assert (reader.turns, reader.chars) == (len(turns), len(whole))
    assert reader.all.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_machine_and_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, None, None, "y"), (3, 0, "user", "<|end|>" * 2000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS pos", "'z' AS segment")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(c)).collect()}
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["n_turns"] == 2 and got[2]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert got[3]["turns_sha256"] == hashlib.sha256(("user\n" + "<|end|>" * 2000 + "\n").encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(c.limit(0))).count() == 0


def test_draws_of_a_mix_are_not_broadcast(spark):
    from tessera.llm import mixing

    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.repeat(F.lit("a b "), 100).alias("text"))
    for made in (mixing.mix(docs), mixing.mixed_blocks(docs)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "BroadcastHashJoin" in line]
        assert "SortMergeJoin" in plan and not any("block#" in line for line in joins)
