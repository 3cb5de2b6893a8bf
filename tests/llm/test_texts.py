"""Near-duplicates, splitting, tokenising, mixing and text kinds."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagebrook.llm import mixing, neardup, quality, splitting, tokenizer
from sagebrook.llm.tokenizer import BytePairTokenizer, vocabulary_path

WORDS = [f"w{n}" for n in range(400)]


def near_texts(groups=12, seed=1, edits=4):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(60)]
        for k in range(rng.randint(1, 4)):
            text = list(base)
            for _ in range(k * edits):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
            out.append((len(out) + 1, " ".join(text)))
    return out


def jaccard_pairs(rows, size, threshold, least=0):
    sets = {}
    for i, text in rows:
        w = neardup.words(text or "")
        if len(w) >= max(size, least):
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.5), (5, 0.8)])
def test_near_duplicates_against_brute_force(spark, size, threshold):
    rows = near_texts(edits=4 if size == 3 else 1)
    rows += [(1000, rows[0][1]), (1001, rows[0][1].upper()), (1002, None), (1003, ""), (1004, "one two"), (1005, "one two")]
    df = spark.createDataFrame(rows + rows[:3] + [(None, rows[0][1])], "id long, content string").withColumn("h", F.lit("clash")).withColumn("keys", F.lit(1))
    got = {tuple(r) for r in neardup.similar_pairs(df, "id", "content", size=size, threshold=threshold).collect()}
    want = jaccard_pairs(rows, size, threshold)
    assert len(want) > 5 and got == want


def test_near_duplicate_groups(spark):
    rows = near_texts(4) + [(500, "a b c d e f"), (501, "a b c d e f"), (502, "A, b c d e f!")]
    out = {r.id: r for r in neardup.near_duplicate_groups(spark.createDataFrame(rows, "id long, content string"), size=3, threshold=0.5).collect()}
    assert {out[i].group_id for i in (500, 501, 502)} == {500} and out[502].class_size == 3 and out[500].keep and not out[501].keep
    assert sum(r.keep for r in out.values()) == len({r.group_id for r in out.values()})


def test_near_duplicates_a_third_copies(spark):
    rows = near_texts(6) + [(n, "the same text that is here again and again in one third of the rows of this table " * 2) for n in range(2000, 2030)]
    members, pairs = neardup.similar_texts(spark.createDataFrame(rows, "id long, content string"), size=3, threshold=0.5)
    assert members.where("id >= 2000").select("h").distinct().count() == 1
    assert pairs.count() == len({(a, b) for a, b in jaccard_pairs(near_texts(6), 3, 0.5)})
    assert neardup.similar_pairs(spark.createDataFrame([], "id long, content string")).count() == 0


def test_a_crowded_band_is_met_in_pairs_of_blocks(spark, monkeypatch):
    """Near-copies of one template: every pair is found, whatever the size of a block."""
    words_ = [f"w{n}" for n in range(90)]
    rows = [(n + 1, " ".join([*words_[:n], f"own{n}", *words_[n:]])) for n in range(60)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = []
    for block in (1000, 7):
        monkeypatch.setattr(neardup, "BAND_BLOCK", block)
        got.append({tuple(r) for r in neardup.similar_pairs(df, size=3, threshold=0.8).collect()})
    assert got[0] == got[1] == jaccard_pairs(rows, 3, 0.8) and len(got[0]) == 60 * 59 // 2


def test_rates_of_many_repeats():
    for mean, cap in ((700.0, 2000), (1500.0, 1600)):
        assert abs(cap - sum(mixing.capped_rate(mean, cap)) - mean) < 1e-6 * mean


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            both = rng.integers(0, 2**63, 400).astype(np.uint64)
            k = int(400 * share)
            a, b = both[: k + (400 - k) // 2], np.concatenate([both[:k], both[k + (400 - k) // 2 :]])
            runs, owner = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            m = neardup.marks(neardup.registers(runs, owner, 2))
            errors.append(neardup.estimate(m[:1], m[1:])[0] - k / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_compressed_registers():
    sketch = neardup.registers(np.empty(0, np.uint64), np.empty(0, np.int64), 2)
    assert (sketch == neardup.EMPTY).all() and neardup.estimate(neardup.marks(sketch[:1]), neardup.marks(sketch[1:]))[0] == 0


# --- splitting ---


@given(st.text(st.sampled_from("ab c.\n\r#-<>p/é👩‍🚀🇺🇸`d"), max_size=900), st.sampled_from(["markdown", "html", "elixir", "plain", "other"]), st.integers(20, 120), st.integers(0, 40))
@settings(max_examples=120, deadline=None)
def test_split_invariants(text, fmt, limit, overlap):
    spans = splitting.split_text(text, fmt, limit, overlap)
    if not text:
        assert spans == []
        return
    overlap = min(overlap, limit // 2)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(nxt[0] == max(0, prev[1] - overlap) and nxt[1] > prev[1] for prev, nxt in zip(spans, spans[1:]))
    assert len(spans) == 1 or len(text) > limit


def test_split_at_natural_boundaries():
    text = "\n\n".join(f"# Part {n}\n\n" + "Some words are here. " * 12 for n in range(12))
    cuts = [b for _, b in splitting.split_text(text, "markdown", 600, 60)[:-1]]
    assert sum(text[c : c + 2] == "# " for c in cuts) >= len(cuts) * 0.8
    html = "".join(f"<p>paragraph {n} of the page</p>" for n in range(80))
    assert all(html[b - 4 : b] == "</p>" for _, b in splitting.split_text(html, "html", 300, 30)[:-1])


def test_edit_alters_neighbouring_pieces_only():
    rng = random.Random(5)
    text = " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(3000))
    pieces = lambda t: {t[a:b] for a, b in splitting.split_text(t, "plain", 900, 90)}
    before, after = pieces(text), pieces(text[:7000] + " an inserted stretch of words " + text[7000:])
    assert len(after - before) <= 5 and len(before & after) >= len(before) - 5


def test_no_boundary_and_bad_limits():
    assert all(b - a <= 50 for a, b in splitting.split_text("x" * 1000, "plain", 50, 10))
    assert splitting.split_text(None, "plain", 10) == []
    with pytest.raises(ValueError):
        splitting.split_text("x", "plain", 0)


def test_cut_quality(spark):
    text = "One line of words.\n" * 40
    df = spark.createDataFrame([(1, text, "a.md"), (1, text, "a.md"), (2, "x" * 900, "b.md"), (3, None, "c.md"), (4, "short", "d.md")], "id long, content string, source string")
    limits = spark.createDataFrame([("md", "markdown", 200, 20), ("other", "text", 100, 10)], "ext string, fmt string, max_chars int, overlap_chars int")
    rows = {r["rank"]: (r.cuts, r.share) for r in splitting.cut_quality(df, limits).collect()}
    assert rows[-1][0] > 0 and sum(n for n, _ in rows.values()) == sum(len(splitting.split_text(t, "markdown", 200, 20)) - 1 for t in (text, "x" * 900))
    assert abs(sum(share for _, share in rows.values()) - 1) < 1e-5
    assert splitting.cut_quality(df.where("false"), limits).count() == 0


def test_split_table(spark):
    limits = spark.createDataFrame([("md", "markdown", 30, 5), ("other", "other", 20, 5)], "ext string, fmt string, max_chars int, overlap_chars int")
    long_ = "word " * 10
    rows = [(1, long_, "./a/B.MD?x=1#y"), (1, long_, "./a/B.MD?x=1#y"), (2, long_[:25], "a.md"), (3, long_[:25], "a.b/c"), (4, long_[:25], None), (5, None, "a.md"), (6, "", "a.md"), (7, long_, "a.xyz")]
    df = spark.createDataFrame(rows, "id long, content string, source string").withColumn("fmt", F.lit("clash")).withColumn("l", F.lit(0))
    out = splitting.split_oversized(df, limits).collect()
    assert {(r.id, r.fmt) for r in out} == {(1, "markdown"), (3, "other"), (4, "other"), (7, "other")}
    assert all(r.text == dict((i, c) for i, c, _ in rows)[r.id][r.start : r.end] for r in out)
    assert len([r for r in out if r.id == 1 and r.piece == 0]) == 1
    assert splitting.split_oversized(df.where("false"), limits).count() == 0 and splitting.split_oversized(df, limits.where("false")).count() == 0


# --- tokenizer ---

ODD = ["", "hello world", "  two  spaces \n\n new", "<|endoftext|> is text", "don't we'll I'm", "日本語のテキスト", "👩‍🚀🇺🇸é́", "a" * 5000, "x y z", "\r\n\t", "1234567890 ½ ²", "�\x00\x1f", "ﷺ" * 50]


def test_ids_equal_public_implementations():
    own = BytePairTokenizer(vocabulary_path())
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    public.encode_special_tokens = True
    for text in ODD:
        assert own.encode(text) == public.encode(text, add_special_tokens=False).ids, text[:20]
        assert own.decode(own.encode(text)) == text
        assert own.count(text) == len(own.encode(text))
    assert BytePairTokenizer(vocabulary_path("byte_bpe_50k.json")).encode(ODD[2]) == own.encode(ODD[2])
    multi = BytePairTokenizer(vocabulary_path("byte_bpe_multi_50k"))
    assert all(multi.decode(multi.encode(t)) == t for t in ODD)


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_round_trip(text):
    own = tokenizer.tokenizer(vocabulary_path())
    assert own.decode(own.encode(text)) == text


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenizer, "REMEMBERED", 3)
    own = BytePairTokenizer(vocabulary_path())
    assert [own.encode(w) for w in ("aa bb cc dd ee", "aa bb cc dd ee")][0] == own.encode("aa bb cc dd ee") and len(own._memory) <= 3


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world")], "doc_id long, text string").withColumn("__text", F.lit("clash"))
    out = sorted((r.doc_id, r.ids) for r in tokenizer.encode_ids(df, "text", ["doc_id"]).collect())
    assert out == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, [])]
    assert sorted(r.n_tokens for r in tokenizer.count_tokens(df, "text", ["doc_id"]).collect()) == [0, 0, 2, 2]
    back = tokenizer.decode_ids(tokenizer.encode_ids(df, "text", ["doc_id"]), "ids", ["doc_id"])
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "hello world"), (1, "hello world"), (2, ""), (3, "")]
    assert tokenizer.encode_ids(df.where("false"), "text", ["doc_id"]).count() == 0


# --- mixing ---


def test_mix(spark):
    sized = spark.range(30000).selectExpr("id doc_id", "CASE WHEN id % 10 < 7 THEN ' Big-One ' WHEN id % 10 = 7 THEN 'small' WHEN id % 10 = 8 THEN NULL ELSE 'other' END source", "100 + id % 50 n_tokens", "1 u")
    targets = spark.createDataFrame([("big_one", 0.5, 1), ("SMALL", 0.45, 4), ("podcast", 0.05, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    mix, shares = mixing.draw_mix(sized, targets)
    report = {r.source: r for r in shares.collect()}
    assert set(report) == {"big_one", "small", "podcast"} and report["podcast"].share == 0
    assert abs(report["big_one"].share - 0.5 / 0.95) < 0.02 and abs(sum(r.share for r in report.values()) - 1) < 1e-5
    uses = mix.groupBy("doc_id", "source").agg(F.max("copy").alias("m"), F.count("*").alias("n"))
    assert uses.where("m <> n").count() == 0 and {r.source: r.m for r in uses.groupBy("source").agg(F.max("m").alias("m")).collect()} == {"big_one": 1, "small": 4}
    again = mixing.draw_mix(sized.repartition(7), targets)[0]
    assert mix.exceptAll(again).count() == 0
    keys = [r.shuffle_key for r in mix.collect()]
    assert keys == sorted(keys)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2), ("b", None, None)], "source string, weight double, max_repeats int")
    mix, shares = mixing.draw_mix(empty, targets)
    assert mix.count() == 0 and shares.count() == 2
    assert mixing.draw_mix(spark.createDataFrame([(1, "a", 5), (2, "b", None)], empty.schema), targets)[0].count() == 2
    assert mixing.draw_mix(empty, targets.where("false"))[1].count() == 0


def test_capped_rate():
    for mean, cap in ((0.3, 1), (0.9, 1), (1.7, 3), (3.9, 4)):
        assert abs(cap - sum(mixing.capped_rate(mean, cap)) - mean) < 1e-6
    assert mixing.capped_rate(4, 4) == [0.0] * 4 and mixing.capped_rate(0, 3) == [1.0]
    plan = mixing.plan_mix({"a": 1000, "b": 10}, {"a": (0.5, 1), "b": (0.5, 2)}, 600)
    assert plan["b"] == 2 and abs(plan["a"] - 0.58) < 1e-9


# --- text kinds ---

PROSE = "The night was long and the road was not easy, but they had to go on because there was no other way to the town."
ITEMS = ["blue lamp", "old door", "steel frame", "garden chair", "paper box", "green field", "winter coat", "round stone", "glass bowl", "river bank"]
KINDS = {
    "prose": [PROSE * 6, "\n".join([PROSE] * 5), (PROSE * 5).lower().replace(",", "").replace(".", ""), PROSE * 5 + "\n\n- blue lamp\n- old door\n\n" + PROSE],
    "list": ["\n".join(f"- {x}" for x in ITEMS), "\n".join(ITEMS), ", ".join(ITEMS * 3), "\n".join(f"{n}. {x}" for n, x in enumerate(ITEMS)), "\n".join(f"{a}: {b}" for a, b in zip(ITEMS, ITEMS[1:]))],
    "table": ["\n".join(f"{x},{n},{n * 7},yes" for n, x in enumerate(ITEMS)), "\n".join(f"| {x} | {n} |" for n, x in enumerate(ITEMS)), "\n".join(f"{x}\t{n}\tno" for n, x in enumerate(ITEMS))],
    "junk": ["xqzj wvkq pzxh qqkz jwxv zkqp " * 8, "click now " * 60, "Qk9fT" * 60, "\n".join(f"2024-01-{n + 10}T10:00:00 INFO id={n} code=0 size={n * 3}" for n in range(12)), "### @@ ~~ %% ^^ && ** ||" * 12],
}


def test_kinds_on_held_out_texts(spark):
    rows, want = [], {}
    for n in range(200):
        for kind, texts in KINDS.items():
            k = len(rows)
            rows.append((k, texts[n % len(texts)]))
            want[k] = kind
        rows.append((len(rows), PROSE * (2 + n % 5)))
        want[len(rows) - 1] = "prose"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kind for r in quality.text_kinds(df).collect()}
    wrong = {k for k in want if got[k] != want[k]}
    assert len(wrong) < 0.03 * len(want), [(want[k], got[k], dict(rows)[k][:60]) for k in list(wrong)[:5]]


def test_kinds_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, PROSE), (4, PROSE), (None, PROSE), (5, "x" * 300_000), (6, "\x00")], "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("words", F.lit(0))
    out = [(r.doc_id, r.written, r.kind) for r in quality.text_kinds(df).collect()]
    assert len(out) == 8 and {k for i, w, k in out if i in (1, 2, 3)} == {None} and [w for i, w, _ in out if i == 4] == [True, True]
    assert quality.text_kinds(df.where("false")).count() == 0
    assert quality.text_kinds(df.where("doc_id < 4")).where("kind IS NOT NULL").count() == 0


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics("The cat sat. The dog ran!\nIt was 12.")))
    assert s["words"] == 8 and s["ended_lines"] == 1 and s["stops"] == 3 / 9 and 0 < s["digit_ratio"] < 0.1 and s["lines"] == 2 and s["longest_line"] == 6
    rows = dict(zip(quality.STATISTICS, quality.statistics("a|b|c\n1|2|3\nx|y|z\nend")))
    assert rows["cells"] == 2 and rows["even_cells"] == 15 / 18 and rows["mid_words"] == 3


def test_mixture_needs_no_examples_to_fit(spark):
    """Components come from the texts; the examples only name them."""
    df = spark.createDataFrame([(n, texts[n % len(texts)]) for n, texts in enumerate(list(KINDS.values()) * 30)], "doc_id long, text string")
    stats = quality.text_statistics(df)
    few = quality.fit_mixture(stats, "doc_id", components=12, rounds=4)
    assert len(few.means) >= 12 and abs(few.weights.sum() - 1) < 1e-9
    assert (abs(few.kinds.sum(axis=1) - 1) < 1e-9).all() and (few.variances > 0).all()
