import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tokenmill import queries
from tokenmill.config import BuildConfig
from tokenmill.functions import checks, text, toolcalls
from tokenmill.operators import build, collate, metrics, numerics, pack, scans
from tokenmill.operators.tokenize import TOKENIZERS, Codepoints, VocabularyFile
from tokenmill.plans import corpus
from tokenmill.registry import Registry
from tokenmill.sources import json_files, store
from tokenmill.streaming import decode, pages

MSG = "array<struct<role:string,content:string>>"
MASKS = {"system": "mask", "user": "mask", "assistant": "train"}


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", list: "array<int>"}
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


# --- configuration and registry
def test_config_defaults_round_trip_and_coercion(tmp_path):
    c = BuildConfig.from_dict({"preprocessing": {"max_seq_len": 64.0, "unknown": 1}, "mask": MASKS, "output": {"domain_key": "d"}})
    assert c.max_seq_len == 64 and c.min_chars == 50 and c.max_tokens_per_shard == 100_000_000
    c.to_file(str(tmp_path / "c.json"))
    assert BuildConfig.from_file(str(tmp_path / "c.json")) == c


def test_registry():
    r = Registry()
    r.register("a")(lambda x: x)
    assert r.create("a", x=3, y=4) == 3 and r.is_registered("a") and r.list_registered() == ["a"]
    with pytest.raises(ValueError):
        r.register("a")(len)
    with pytest.raises(ValueError):
        r.get("b")
    with pytest.raises(TypeError):
        Registry(dict).register("x")(list)


# --- build
def chat(spark, rows):
    return spark.createDataFrame(rows, f"id long, messages {MSG}, source string, extra string")


def test_chat_masks_and_bos(spark):
    rows = [(1, [("system", "s"), ("user", "u"), ("assistant", "a"), ("ghost", "x")], "d", ""), (2, None, "d", ""), (3, [], None, ""), (4, [("user", None)], None, "")]
    got = {r.id: r for r in build.build(chat(spark, rows), corpus.CHAT_CONFIG, Codepoints(bos_id=7), keep=("id",)).collect()}
    assert set(got) == {1, 4} and got[4].domain == "__default__"
    parts = [f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in (("system", "s"), ("user", "u"), ("assistant", "a"))]
    assert got[1].sequence == [7, *map(ord, "".join(parts))]
    assert got[1].loss_mask == [0] * (1 + len(parts[0] + parts[1])) + [1] * len(parts[2])


def test_text_bounds_and_instruction(spark):
    rows = spark.createDataFrame([(1, "short", "r"), (2, "x" * 60, "r"), (3, "  \n", "r"), (4, None, "r"), (5, "y" * 2_000_001, "r")], "id long, prompt string, response string")
    text_only = BuildConfig.from_dict({"input": {"sections": [{"field": "prompt"}]}})
    assert [r.id for r in build.build(rows, text_only, keep=("id",)).collect()] == [2]
    both = BuildConfig.from_dict({"input": {"sections": [{"field": "prompt", "action": "mask"}, {"field": "response", "action": "train"}]}, "preprocessing": {"max_seq_len": 6}})
    got = {r.id: r for r in build.build(rows, both, keep=("id",)).collect()}
    assert got[1].sequence == list(map(ord, "shortr")) and got[1].loss_mask == [0] * 5 + [1] and got[3].sequence == [ord("r")] and got[3].loss_mask is None


def test_sources_lists_and_values(spark):
    rows = spark.createDataFrame([(1, "ask", ["ab", "", "c"], [1.0, 0.8])], "id long, prompt string, responses array<string>, rewards array<double>")
    conf = BuildConfig.from_dict({"input": {"sources": {
        "prompts": {"sections": [{"field": "prompt", "action": "mask"}], "mask_key": "pm"},
        "responses": {"sections": [{"field": "responses", "action": "train"}], "list_field": True, "mask_key": "masks"},
        "rewards": {"sections": [{"field": "rewards", "action": "value"}]}}}, "preprocessing": {"min_chars": 0}})
    r = build.build(rows, conf).first()
    assert r.prompts == [97, 115, 107] and r.pm == [0, 0, 0] and r.responses == [[97, 98], [99]] and r.masks == [[1, 1], [1]] and [round(x, 3) for x in r.rewards] == [1.0, 0.8]


def test_instruction_messages_and_prompt(spark):
    df = spark.createDataFrame([("i", "", "o")], "a string, b string, c string")
    m = df.select(build.instruction_messages(F.col("a"), F.col("b"), F.col("c")).alias("m")).first().m
    assert [(x.role, x.content) for x in m] == [("system", "i"), ("assistant", "o")]
    r = df.select(build.render_chat(build.instruction_messages(F.col("a"), F.col("b")), True, "sys").alias("t")).first().t
    assert r == "<|im_start|>system\nsys<|im_end|>\n<|im_start|>system\ni<|im_end|>\n<|im_start|>assistant\n"


def test_tokenizers(spark, tmp_path):
    df = spark.createDataFrame([("a 漢👩",), (None,), ("",)], "t string")
    cp = TOKENIZERS.create("codepoint")
    ids = [r.i for r in df.select(cp.ids(F.col("t")).alias("i")).collect()]
    assert ids == [[97, 32, 0x6F22, 0x1F469], None, []]
    back = df.select(cp.text(cp.ids(F.col("t"))).alias("t")).collect()
    assert [r.t for r in back] == ["a 漢👩", None, ""]
    import public_tokenizers

    v = VocabularyFile(public_tokenizers.path("byte_bpe_50k.json"))
    v.save(str(tmp_path / "v"))
    v = VocabularyFile.load(str(tmp_path / "v"))
    enc = v.encode(df.withColumn("ids_", F.lit(1)), "t")
    assert [r.text for r in v.decode(enc, "ids").collect()] == ["a 漢👩", None, ""]


# --- packing
def scan_plan(lengths, most):
    free, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -min(lengths[i], most)):
        n = min(lengths[i], most)
        fits = [(f, b) for b, f in enumerate(free) if f >= n]
        if fits:
            b = min(fits)[1]
        else:
            b = len(free)
            free.append(most)
        free[b] -= n
        out[i] = b
    return out


def test_best_fit_equals_scan():
    r = random.Random(1)
    for _ in range(500):
        lengths = [r.randint(0, 14) for _ in range(r.randint(0, 30))]
        assert pack.plan_best_fit(lengths, 10) == scan_plan(lengths, 10)


def test_split_keeps_what_bfd_loses(spark):
    rows = spark.createDataFrame([(1, list(range(25)), 0), (2, list(range(100, 108)), 0)], "id long, sequence array<int>, g int")
    split = pack.pack(rows, "id", ["sequence"], 10, ["g"], "bfd_split").collect()
    assert sorted(x for r in split for x in r.sequence) == sorted([*range(25), *range(100, 108)]) and all(len(r.sequence) <= 10 for r in split)
    assert sum(len(r.sequence) for r in pack.pack(rows, "id", ["sequence"], 10, ["g"], "bfd").collect()) == 18
    with pytest.raises(ValueError):
        pack.pack(rows, "id", ["sequence"], 10, ["g"], "other")


# --- streams and samplers
def test_windows(spark):
    assert scans.window_count(200, 64, 64) == 3 and scans.window_count(30, 64, 64) == 0
    segs = spark.createDataFrame([(0, [0, 1, 2]), (1, []), (2, None), (3, [3]), (4, [4, 5, 6, 7, 8])], "i long, ids array<int>")
    got = {r.window_id: (r.input, r.target) for r in scans.stream_windows(segs, "i", "ids", 5, 3).collect()}
    assert got == {0: ([0, 1, 2, 3, 4], [1, 2, 3, 4, 5]), 1: ([3, 4, 5, 6, 7], [4, 5, 6, 7, 8])}
    assert scans.stream_windows(segs.limit(0), "i", "ids", 5, 3).count() == 0


def test_epochs_reset(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([6, 6, 6, 1, 9, 10, 1])], "i long, n int")
    assert [r.epoch for r in scans.shard_epochs(rows, "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 1, 1, 2, 3]
    assert [r.epoch for r in scans.shard_epochs(rows, "i", "n", 10, "floor").orderBy("i").collect()] == [0, 0, 1, 1, 1, 2, 3]


@pytest.mark.parametrize("bucket, kept", [(7, 10**6), (7, 0), (10**6, 10**6)])
def test_epochs_over_ranges_equal_a_running_total(spark, bucket, kept):
    r = random.Random(bucket + kept)
    rows = [(r.randint(-(2**62), 2**62), r.choice([None, 0, 1, 5, 40, 300])) for _ in range(120)]
    total, epoch, want = 0, 0, {}
    for i, n in sorted(rows):
        want[i], total = epoch, total + (n or 0)
        if total >= 100:
            total, epoch = 0, epoch + 1
    got = {x.i: x.epoch for x in scans.shard_epochs(spark.createDataFrame(rows, "i long, n int"), "i", "n", 100, bucket=bucket, kept=kept).collect()}
    assert got == want
    assert scans.shard_epochs(spark.createDataFrame([], "i long, n int"), "i", "n", 100).count() == 0


def test_prefix_sum_over_sparse_order(spark):
    r = random.Random(4)
    rows = [(r.randint(-(2**62), 2**62), r.randint(0, 9)) for _ in range(300)]
    run, want = 0, {}
    for i, n in sorted(rows):
        want[i], run = run, run + n
    assert {x.i: x.offset for x in scans.prefix_sum(spark.createDataFrame(rows, "i long, n int"), "i", "n", bucket=20).collect()} == want


def test_positions(spark):
    df = spark.createDataFrame([([0, 1, 2, 0, 1, 0],)], "p array<int>")
    assert df.select(scans.document_ids(F.col("p")).alias("d")).first().d == [0, 0, 0, 1, 1, 2]
    assert df.select(scans.position_ids(F.col("p"), "continuous", F.lit(10)).alias("d")).first().d == [10, 11, 12, 13, 14, 15]
    assert scans.position_ids(F.col("p"), "none") is None


def test_sampler_is_seeded_and_resumes(spark):
    df = spark.range(0, 23)
    order = lambda **k: [r.id for r in scans.sampler(df, "id", **k).orderBy("step").collect()]
    a = order(seed=1)
    assert sorted(a) == list(range(23)) and a == order(seed=1) and a != order(seed=2) and order(seed=2) == order(seed=1, epoch=1)
    assert order(seed=1, resume=5) == a[5:] and order(seed=1, resume=28) == a[5:] and order(seed=1, shuffle=False) == list(range(23))
    parts = [order(seed=1, replicas=4, rank=r) for r in range(4)]
    assert [len(p) for p in parts] == [6] * 4 and [parts[i % 4][i // 4] for i in range(23)] == a and parts[3][5] == a[0]
    # a resumed replica gives the rest of the same epoch, padding included
    assert [order(seed=1, replicas=4, rank=r, resume=2) for r in range(4)] == [p[2:] for p in parts]
    assert [len(order(seed=1, replicas=4, rank=r, drop_last=True)) for r in range(4)] == [5] * 4
    assert [len([x for x in scans.sampler(spark.range(1), "id", 1, replicas=4, rank=r).collect()]) for r in range(4)] == [1, 1, 0, 0]
    assert scans.sampler(spark.range(0), "id", 1).count() == 0 and scans.sampler(spark.range(3), "id", 1, replicas=4, drop_last=True).count() == 0
    assert (scans.sampler_length(23, 4), scans.sampler_length(23, 4, 2), scans.sampler_length(23, 4, 8), scans.sampler_length(0)) == (6, 4, 4, 0)
    assert scans.sampler_next(23, 3, 2, 4) == (4, 0)
    assert scans.split_validation(df, "id", 0.001, 1).filter("is_validation").count() == 1


# --- scores
def test_lcs_against_table():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert metrics.lcs_length(a, b) == t[-1][-1]


def test_difficulty_reasons(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], [2.0, 2.0]), (2, [], [1.0]), (3, [1.0], [1.0, 2.0]), (4, [1.0], [0.0])], "k long, c array<double>, u array<double>")
    got = {r.k: (r.ifd, r.skip_reason) for r in metrics.difficulty(rows, "k", "c", "u").collect()}
    assert got == {1: (0.75, None), 2: (None, "empty response"), 3: (None, "lengths differ"), 4: (None, None)}
    s = metrics.difficulty_summary(metrics.difficulty(rows, "k", "c", "u")).first()
    assert (s["count"], s.valid, s.skipped, s.stdev) == (4, 1, 3, 0.0)


def test_weight_stats(spark):
    r = metrics.weight_stats(spark.createDataFrame([("eye", [[1.0, 0.0], [0.0, 1.0]])], "name string, matrix array<array<double>>")).first()
    assert (r.er_90, r.er_99, round(r.entropic_rank, 6), r.condition) == (2, 2, 2.0, 1.0)


def test_trim_pair_and_stop(spark):
    df = spark.createDataFrame([(list(range(10)), list(range(100, 108)))], "c array<int>, r array<int>")
    c, r = metrics.trim_pair(F.col("c"), F.col("r"), 8)
    assert df.select(c.alias("c"), r.alias("r")).first() == ([6, 7, 8, 9], [100, 101, 102, 103])
    assert one(spark, metrics.trim_stop(F.col("t"), ["\ndef", "\nclass"]), t="a\nclass b\ndef c") == "a"
    assert one(spark, text.cut_at_last(F.col("t"), F.lit("##")), t="a##b##c") == "a##b"


@pytest.mark.parametrize(
    "name, kwargs, good, bad",
    [
        ("keywords:existence", {"keywords": ["a.b", "ÄH"]}, "äh A.B", "äh aXb"),
        ("keywords:frequency", {"keyword": "the"}, "Other", "no"),
        ("keywords:frequency", {"keyword": "the", "frequency": 2, "relation": "less than"}, "the", "the the"),
        ("keywords:frequency", {"keyword": "a", "relation": None}, "a", "b"),
        ("keywords:forbidden_words", {"forbidden_words": ["cat"]}, "category", "a Cat."),
        ("keywords:forbidden_words", {"forbidden_words": ["self-aware", "don't"]}, "selfaware dont", "it is Self-Aware now"),
        ("keywords:forbidden_words", {"forbidden_words": ["c++"]}, "I like c++ a lot", "I like c++x"),
        ("keywords:letter_frequency", {"letter": "E"}, "see", "ooo"),
        ("keywords:letter_frequency", {"letter": "e", "let_frequency": 3, "let_relation": "less than"}, "see", "seee"),
        ("detectable_content:number_placeholders", {}, "[]", "[a\nb]"),
        ("detectable_content:number_placeholders", {"num_placeholders": 2}, "[a] [[b]", "[a [b]"),
        ("detectable_content:postscript", {}, "so it is, p. s. or not", "x"),
        ("detectable_content:postscript", {"postscript_marker": "P.P.S"}, "a p.\np. s", "P.S."),
        ("detectable_content:postscript", {"postscript_marker": "N.B."}, "see n.b. here", "nxbx"),
        ("detectable_format:number_bullet_lists", {"num_bullets": 3}, "-one\n  *two\n- three", "- one\n**two**\n- three"),
        ("detectable_format:number_bullet_lists", {}, "a\n\n - b", "a"),
        ("detectable_format:number_highlighted_sections", {"num_highlights": 2}, "*a* and *b*", "*a* and * *"),
        ("detectable_format:number_highlighted_sections", {}, "*a*", "**"),
        ("detectable_format:multiple_sections", {"section_spliter": "Part.", "num_sections": 2}, "Part.1 a Part. 2 b", "PartX 1 Part. 2"),
        ("detectable_format:multiple_sections", {}, "Section 1", "Section one"),
        ("detectable_format:title", {}, "<<a>>", "<<<  >>"),
        ("detectable_format:json_format", {}, '```JSON\n{"a": 1}\n```', "{a"),
        ("detectable_format:json_format", {}, " [1, null] ", "```json```"),
        ("detectable_format:general_punctuation", {"punctuation_blacklist": [";", "!"]}, "a.", "a!"),
        ("detectable_format:number_highlighted_words", {}, "*bold words*", "*a*"),
        ("startend:end_checker", {"end_phrase": " The End "}, 'so, the END"  \n', "the end."),
        ("startend:quotation", {}, '\n"a" ', 'a"'),
        ("startend:quotation", {}, '"', "'"),
        ("startend:start_checker", {"starter": "If"}, "x\n \t\nIf so", "if so"),
        ("change_case:english_capital", {}, "A1", "Aa"),
        ("change_case:english_lowercase", {}, "a1", "12"),
        ("change_case:capital_word_frequency", {}, "AB c", "Ab"),
        ("change_case:capital_word_frequency", {"capital_frequency": 1, "capital_relation": "less than"}, "ABc", "AB"),
        ("punctuation:no_comma", {}, "a", "a,"),
        ("length_constraints:number_words", {}, "w " * 100, "w " * 99),
        ("length_constraints:number_words", {"num_words": 2, "relation": "less than"}, "it_is", "it's"),
        ("length_constraints:number_sentences", {}, "A. B! C? D. E.", "A. B.C. D. E"),
        ("length_constraints:number_sentences", {"num_sentences": 2, "relation": "less than"}, "One.", "One. Two! Three?"),
        ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a\n\n\nb", "a\n \nb"),
        ("length_constraints:number_paragraphs", {"num_paragraphs": 2}, "a***b*** ", "a\n\nb***"),
        ("length_constraints:nth_paragraph_first_word", {"num_paragraphs": 2, "nth_paragraph": 2, "first_word": "So"}, 'a\n\n "so," it', "a\n\nNo"),
        ("length_constraints:nth_paragraph_first_word", {"first_word": "x"}, "X y", "x\n\ny"),
        ("length_constraints:nth_word_checker", {"nth_word": 2, "target_word": "Two"}, "one two", "one"),
        ("combination:repeat_prompt", {"prompt_to_repeat": " Say it "}, " say IT again", "it say"),
        ("combination:two_responses", {}, "a ****** b ******", "a ****** a"),
    ],
)
def test_checks(spark, name, kwargs, good, bad):
    """Expected values are those of the survey's definitions, with arguments as JSON and as literals."""
    for t, want in ((good, True), (bad, False)):
        assert one(spark, checks.verdict(F.lit(name), F.col("t"), F.lit(json.dumps(kwargs))), t=t) is want
        assert one(spark, checks.holds(name, F.col("t"), kwargs), t=t) is want
    assert len(checks.CHECKS.list_registered()) == 27


def test_unknown_check_is_null_and_missing_or_null_argument_false(spark):
    assert one(spark, checks.verdict(F.lit("no:such"), F.col("t"), F.lit("{}")), t="x") is None
    for name, kwargs in (("keywords:existence", "{}"), ("keywords:frequency", '{"keyword": "x", "frequency": null}'), ("length_constraints:number_words", '{"num_words": null}')):
        assert one(spark, checks.verdict(F.lit(name), F.col("t"), F.lit(kwargs)), t="x") is False


def test_instruction_report(spark):
    ids = ["punctuation:no_comma", "odd:one", "change_case:english_capital"]
    rows = spark.createDataFrame([(1, 0, "a,", ids, ["{}", "{}"]), (1, 1, "a", ids, ["{}", "{}"]), (2, 0, "a", ["odd:one"], [])], "key long, sample int, response string, instruction_id_list array<string>, kwargs array<string>")
    r = checks.instruction_report(rows)
    assert {x.key: tuple(x)[1:] for x in r["by_problem"].collect()} == {1: (3, 2, 1, 0.5), 2: (1, 0, 0, None)}
    assert {x.instruction: tuple(x)[1:] for x in r["by_type"].collect()} == {"punctuation:no_comma": (1, 1, 1.0), "change_case:english_capital": (1, 0, 0.0)}
    assert tuple(r["summary"].first()) == (2, 2, 1, 0.5, 2)


def test_choice_prompts(spark):
    rows = spark.createDataFrame([(1, "Q1 ?", "law", "B"), (2, None, "law", "C"), (3, "Q3", None, "A")], "id long, question string, subject string, answer string")
    c = [F.lit(x) for x in ("w", "x", None, "z")]
    rows = rows.withColumn("p", metrics.choice_prompt(F.col("question"), c, F.col("subject")))
    got = {r.id: r for r in metrics.few_shot_chat(rows, rows, "id", "subject", "p", "answer", 1).collect()}
    first = "The following are multiple choice questions (with answers) about law.\n\nQuestion: Q1 ?\nA. w\nB. x\nC. \nD. z\nAnswer:"
    assert got[1].p == first
    assert got[1].chat == f"<|im_start|>user\n{first}<|im_end|>\n<|im_start|>assistant\nB<|im_end|>\n<|im_start|>user\n{first}<|im_end|>\n<|im_start|>assistant\n"
    assert got[3].chat.startswith("<|im_start|>user\nThe following") and got[3].chat.count("im_start") == 2
    assert metrics.few_shot_chat(rows, rows, "id", "subject", "p", "answer", 0).filter("chat like '%B<|im_end|>%'").count() == 0
    texts, letter = metrics.permuted_choices(F.col("id"), [F.lit(x) for x in "wxyz"], F.col("answer"), 5)
    for r in spark.range(0, 40).withColumn("answer", F.lit("B")).select(F.array(*texts).alias("t"), letter.alias("a")).collect():
        assert sorted(r.t) == list("wxyz") and r.t["ABCD".index(r.a)] == "x"


@pytest.mark.parametrize(
    "code, want",
    [
        ("x = 1\ndef f(a):\n\n    b = a  \n\n    return b\nprint(f)", "    b = a\n\n    return b"),
        ("def f(a):\nreturn 1", None), ("def g(a):\n    pass", "def g(a):\n    pass"), ("def f(a):", None), ("def f(a) -> int:\n\tpass\n\n", "\tpass\n\n"),
    ],
)
def test_function_body(spark, code, want):
    assert one(spark, metrics.function_body(F.col("t"), F.lit("f")), t=code) == want


def test_left_overflow(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [9])], "c array<int>, x array<int>")
    ids, n = metrics.left_overflow(F.col("c"), F.col("x"), 3)
    assert df.select(ids.alias("i"), n.alias("n")).first() == ([3, 4, 9], 2)
    assert df.select(metrics.choice_score(F.array(F.lit(-1.0), F.lit(-2.0)), F.lit(2), F.lit(2)).alias("s")).first().s == -2.0


def test_grpo_loss_by_hand(spark):
    rows = spark.createDataFrame([(-1.0, -1.0, -2.0, 1.0, 1), (-1.0, -1.0, -2.0, 5.0, 0)], "p double, o double, r double, a double, m int")
    loss = numerics.grpo_token_loss(F.col("p"), F.col("o"), F.col("r"), F.col("a"), kl=1.0)
    got = rows.agg(numerics.token_mean(loss, F.col("m")).alias("x")).first().x
    assert abs(got - (-1.0 + math.exp(-1) + 1 - 1)) < 1e-6  # r = e^-1: r - ln r - 1
    assert rows.limit(0).agg(numerics.token_mean(loss, F.col("m")).alias("x")).first().x == 0.0


# --- numerics
def test_sampling_arguments_and_ties(spark):
    for bad in ({"top_k": -1}, {"top_p": 1.5}, {"temperature": -1}, {"frequency_penalty": 3}, {"rep_window": 0}):
        with pytest.raises(ValueError):
            numerics.validate_sampling(**bad)
    logits = spark.createDataFrame([(0, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 1.0])], "row_id long, token_id int, logit double")
    assert numerics.top_k(logits, 2).count() == 3 and numerics.top_k(logits, 0).count() == 4
    assert [r.token_id for r in numerics.top_p(logits, 0.0).collect()] == [0]
    assert numerics.sample_tokens(logits, 1, temperature=0).first().token_id == 0
    assert numerics.sample_tokens(logits, 1).first() == numerics.sample_tokens(logits, 1).first()


def test_equal_rewards_have_no_advantage(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "g long, i int, reward double")
    assert {r.advantage for r in numerics.group_advantage(df, "g").collect()} == {0.0}
    assert numerics.best_and_worst(df, "g", "i").first()[1:] == (0, 0)


# --- sources
def test_json_modes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2, "y": 3}\n')
    assert sorted(r.x for r in json_files.read_records(spark, str(tmp_path), "x int", "skip").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        json_files.read_records(spark, str(tmp_path), "x int").collect()
    (tmp_path / "b.json").write_text('[{"x": 5}, {"x": 6}]')
    assert sorted(r.x for r in json_files.read_documents(spark, str(tmp_path / "b.json"), "x int").collect()) == [5, 6]
    assert store.detect_format(str(tmp_path)) == "jsonl"
    with pytest.raises(FileNotFoundError):
        store.detect_format(str(tmp_path / "none"))


def test_choices_csv_and_generate(spark, tmp_path):
    (tmp_path / "q.csv").write_text("question,A,B,C,D,answer\nq1,A) w,B) x,y,z,b\nshort,row\n")
    rows = json_files.read_choices(spark, str(tmp_path / "q.csv")).collect()
    assert [(r.question, r.a, r.b, r.answer) for r in rows] == [("q1", "w", "x", "b")]
    df = spark.createDataFrame([("p",)], "prompt string")
    assert json_files.generate(df, lambda ps: [p + "!" for p in ps], "prompt").first().response == "p!"


def test_bin_store(spark, tmp_path):
    rows = spark.createDataFrame([(i, list(range(i))) for i in range(6)], "id long, sequence array<int>")
    path = str(tmp_path / "bin")
    store.write_bin(rows, path, ["sequence"], "id")
    spark.dataSource.register(store.BinSource)
    back = spark.read.format("tokenbin").option("key", "sequence").load(path)
    assert sorted(r["values"] for r in back.collect()) == [list(range(i)) for i in range(6)] and store.detect_format(path) == "bin"
    with pytest.raises(ValueError):
        store.write_bin(rows.select("id", F.array("sequence").alias("sequence")), path, ["sequence"], "id")
    with pytest.raises(KeyError):
        store.require_keys(rows, "sft")


def test_prepare_and_views(spark):
    rows = spark.createDataFrame([(i, "x" * (60 + i), "web" if i % 2 else None) for i in range(20)], "id long, text string, source string")
    conf = BuildConfig.from_dict(corpus.TEXT_CONFIG.to_dict() | {"preprocessing": {"packing_strategy": "bfd", "max_packed_len": 200}, "output": {"domain_key": "source", "max_tokens_per_shard": 500}})
    out = corpus.prepare(rows, "id", conf)
    assert sum(len(r.sequence) for r in out.collect()) == sum(60 + i for i in range(20))
    v = corpus.dataset_view(out, "sft").first()
    assert len(v.input) == len(v.target) == len(v.loss_mask) == len(v.position_ids)
    assert corpus.prepare(rows.limit(0), "id", conf).count() == 0


# --- serving
CALL = 'Look: {"name": "find", "arguments": {"q": "a}\\"b", "n": [1, 2]}} and {"x": {"y": 1}} {"name": "go", "arguments": {}}'


@pytest.mark.parametrize(
    "text, want",
    [
        (CALL, [("find", '"q": "a}\\"b", "n": [1, 2]', True), ("go", "", True)]),
        ('{"name": "f", "arguments": [1]} {"name": "g", "arguments": "s"} {"name": "h", "arguments": null}', [("f", "[1]", True), ("g", "s", True), ("h", "", True)]),
        ('{"name": "f", "parameters": {"a": 1}}', [("f", "", True)]),
        ('{"name": 3} {"x": {"name": "inner"}} {bad}', [("inner", "", False)]), ('{"name": 3} {bad}', []),
        ('{"name": "find", "arguments": {"q": "a', [("find", '"q": "a', False)]),
        ('{"name": "find", "arguments": {"q": 1}', [("find", '"q": 1', False)]),
        ('{"name": "f", "arguments": {"a": 1}} {"name": "g", "arg', [("f", '"a": 1', True), ("g", "", False)]),
        ('{"nam', []), ("no call", []), ("", []), (None, []), ("[{]}", []), ('{"name": "f", "arguments": true}', [("f", "True", True)]),
    ],
)
def test_tool_calls(text, want):
    assert [(c["name"], c["arguments"], c["complete"]) for c in toolcalls.find_calls(text)] == want


def test_tool_calls_whole_and_token_by_token(spark):
    state, events = {}, []
    for ch in CALL:
        events += decode.tool_step(state, ch)
    assert [e["text"] for e in events if e["type"] == "name"] == ["find", "go"]
    assert "".join(e["text"] for e in events if e["type"] == "arguments" and e["index"] == 0) == '"q": "a}\\"b", "n": [1, 2]'
    assert toolcalls.parse_complete(CALL) == {"content": "Look:", "tool_calls": [("find", '"q": "a}\\"b", "n": [1, 2]'), ("go", "")]}
    assert toolcalls.parse_complete('{"name": "f"') is None and toolcalls.parse_complete('{"name": "f"}')["content"] is None
    df = spark.createDataFrame([(CALL,), (None,), ("",)], "t string")
    assert [len(r.tool_calls) for r in toolcalls.parse_tool_calls(df, "t").collect()] == [2, 0, 0]


def test_decode_and_stops():
    whole, state, out = "é漢👩 end", {}, []
    for b in whole.encode():
        out.append(decode.decode_step(state, bytes([b])))
    assert "".join(out) + decode.decode_step(state, b"", last=True) == whole and all("�" not in x for x in out)
    state, shown, hit = {}, "", None
    for ch in "abc STOP def":
        delta, hit = decode.stop_step(state, ch, ["STOP", "END"])
        shown += delta
    assert shown == "abc " and hit == "STOP"


def test_queue_admission_refresh():
    q = decode.TaskQueue(2)
    for t in "abcd":
        q.add(t)
    assert q.refill(lambda t: t != "b") == ["a"] and q.waiting[0] == "b" and q.refill() == ["b"]
    q.end("a"), q.end("c", "aborted")
    assert q.stats() == {"waiting": 1, "active": 1, "finished": 1, "aborted": 1}
    assert decode.admit([1, 2, 3, 4], 9, 3, 5) == ([2, 3, 4], 2) and decode.admit([1, 2, 3], 9, 3, 3) is None
    assert decode.finished([1, 2], 5, [2]) and not decode.finished([2, 1], 5, [2]) and decode.finished([1], 1, [])
    assert decode.prefill_groups([("a", 3, 0), ("b", 3, 0), ("c", 3, 2)]) == {(3, 0): ["a", "b"], (3, 2): ["c"]}
    s = {}
    assert [decode.refresh_due(s, k, i, 3) for k, i in (("x", 0), ("x", 2), ("x", 3), ("y", 4))] == [True, False, True, True]


def test_pages(spark):
    h = one(spark, pages.page_hash(F.col("ids")), ids=[3, 5, 2**31 - 1] * 10)
    want = 0
    for x in [3, 5, 2**31 - 1] * 10:
        want = (want * 31 + x) % 2**64
    assert int(h) == want
    t = pages.PageTable(2)
    a, b = t.alloc(), t.alloc()
    assert (a, b, t.alloc()) == (0, 1, None)
    t.record(a, 111), t.release(a)
    assert t.lookup([111, 222]) == [0]
    t.release(a)
    assert t.alloc() == 0 and t.lookup([111]) == []


def test_corpus_queries_lose_no_text(spark, tmp_path):
    rows = [(1, "ab c" * 2500, "web"), (2, "x" * 100, "web"), (3, "y" * 2049, None), (4, "short", "web"), (5, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = queries.corpus_prepare(spark, str(tmp_path)).collect()
    assert {(x.domain, x.tokens, x.documents, x.within) for x in bins} == {("web", 10100, 2, True), ("__default__", 2049, 1, True)}
    whole = {x.domain: (x.docs, x.tokens) for x in queries.corpus_build_counts(spark, str(tmp_path)).collect()}
    assert whole == {"web": (2, 10100), "__default__": (1, 2049)}


def test_documents_of_packed_rows(spark, tmp_path):
    sizes = {1: 2048, 2: 1500, 3: 500, 4: 40, 5: 9, 6: 0, 7: 1}
    rows = [(i, [7] * n) for i, n in sizes.items()]
    spark.createDataFrame(rows + rows[:2], "record_id long, sequence array<int>").write.parquet(f"{tmp_path}/single_output_mask_builder.parquet")
    got = [(x.epoch, x.documents, x.same) for x in queries.packed_documents(spark, str(tmp_path)).collect()]
    assert got == [(0, 6, True)]


def test_grpo_batches_of_uneven_groups(spark):
    fields = "batch long, record_id long, prompts array<int>, responses array<array<int>>, masks array<array<int>>, rewards array<double>"
    ones = lambda r: [[1] * len(x) for x in r]
    rows = [(b, i, p, r, ones(r), w) for b, i, p, r, w in (
        (0, 1, [7], [[1, 2], [3]], [0.5, 1.0]), (0, 2, [8, 9], [[4]], [2.0]), (0, 3, [5], [[6], [], [1, 1, 1]], [1.0, 2.0, 3.0]), (0, 4, [5], [], []), (1, 5, [3], [], []), (1, 6, [4], [[9]], [1.0]),
    )]
    got = {x.record_id: x for x in collate.collate_grpo(spark.createDataFrame(rows, fields)).collect()}
    none = [0, 0, 0]  # the third answer of 3 is beyond G, yet sets the width
    assert [got[i].responses for i in (1, 2, 3, 4)] == [[[1, 2, 0], [3, 0, 0]], [[4, 0, 0], none], [[6, 0, 0], none], [none, none]]
    assert [got[i].masks for i in (1, 2, 3, 4)] == [[[1, 1, 0], [1, 0, 0]], [[1, 0, 0], none], [[1, 0, 0], none], [none, none]]
    assert [got[i].rewards for i in (1, 2, 3, 4)] == [[0.5, 1.0], [2.0, 0.0], [1.0, 2.0], [0.0, 0.0]]
    assert got[2].prompts == [8, 9] and got[1].prompt_mask == [False, True] and got[5].responses == got[6].responses == got[6].rewards == []


def test_grpo_takes_every_rollout(spark, tmp_path):
    say = lambda *c: [("user", "hi"), *(("assistant", x) for x in c)]
    rows = [(1, say("ab", "c", "defg")), (2, say("x")), (2, say("x")), (3, say()), (4, []), (5, None)]
    spark.createDataFrame(rows, "rollout_id long, messages array<struct<role string, content string>>").write.parquet(f"{tmp_path}/rollout.parquet")
    (x,) = queries.grpo_collate(spark, str(tmp_path)).collect()
    assert (x.rows, x.width, x.group_size, x.longest, x.filled, x.trained) == (3, 2, 3, 4, 4, 8)


def test_every_page_is_hashed_and_cached(spark, tmp_path):
    a, b, c = list(range(16)), list(range(100, 116)), list(range(200, 216))
    rows = [(1, a + b + c[:5], "2024-01-01"), (1, a + b + c[:5], "2024-03-01"), (2, a + b + c, "2024-02-01"), (3, a + c + b, "2024-02-02"), (4, a[:15], "2024-02-03"), (5, c + a, "2024-02-01")]
    spark.createDataFrame(rows, "record_id long, sequence array<int>, t string").selectExpr("record_id", "sequence", "timestamp(t) as built_at").write.parquet(f"{tmp_path}/single_output_mask_builder.parquet")
    fold = lambda ids: str(sum(x * 31 ** (len(ids) - 1 - i) for i, x in enumerate(ids)) % 2**64)
    got = {(x.record_id, x.page): x.hash for x in queries.page_hashes(spark, str(tmp_path)).collect()}
    full = {1: [a, b], 2: [a, b, c], 3: [a, c, b], 5: [c, a]}
    assert got == {(i, k): fold(ids) for i, own in full.items() for k, ids in enumerate(own)}
    cached = {x.record_id: x.cached_pages for x in queries.prefix_cache(spark, str(tmp_path)).collect()}
    assert cached == {1: 0, 2: 2, 3: 3, 4: 0, 5: 0}


def test_stateful_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = [("t1", i, ch) for i, ch in enumerate("hello STOP rest")] + [("t2", i, ch) for i, ch in enumerate("bye")]
    spark.createDataFrame(events, "task string, seq long, piece string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task string, seq long, piece string").parquet(str(tmp_path / "in"))

    def step(state, event):
        delta, _ = decode.stop_step(state, event["piece"], ["STOP"])
        return [{"delta": delta}] if delta else []

    out = decode.run_keyed(stream, "task", "seq", step, "key string, seq long, delta string")
    q = out.writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.sql("select * from deltas order by key, seq").collect():
        got[r.key] = got.get(r.key, "") + r.delta
    assert got == {"t1": "hello ", "t2": "bye"}


def test_metric_stream(spark, tmp_path):
    from tokenmill.streaming.metrics import running_loss, write_log

    rows = spark.sql("select timestamp'2025-01-01 00:10:00' as logged_at, 'train' as kind, 2.0D as loss union all select timestamp'2025-01-01 00:20:00', 'train', 4.0D")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_log(stream, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    q = running_loss(stream).writeStream.format("memory").queryName("losses").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select n, loss from losses").first() == (2, 3.0)


def test_sse():
    assert decode.sse_chunk("t", "m", "x").startswith("data: {") and decode.sse_event("message_stop", {}).startswith("event: message_stop\n")


# --- records, preferences, rollouts
def test_preference_records(spark):
    schema = "record_id long, prompt string, legacy_input string, chosen string, rejected string"
    rows = spark.createDataFrame([(1, "p", None, "c", "r"), (2, "", "old", "c", "r"), (3, "", None, "c", "r"), (4, "p", None, None, "r"), (5, "p" * 50, None, "c", "r")], schema)
    got = {r.record_id: r for r in build.dpo_ids(rows, "codepoint", 70).collect()}
    text = "<|im_start|>user\np<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert "".join(map(chr, got[1].chosen)) == text and sum(got[1].chosen_mask) == len("c<|im_end|>\n") and got[1].chosen_mask[-12:] == [1] * 12
    assert "old" in "".join(map(chr, got[2].chosen)) and not got[3].well_formed and got[3].chosen is None and not got[4].well_formed
    assert len(got[5].chosen) == 70 and sum(got[5].chosen_mask) == 0
    with pytest.raises(Exception, match="malformed"):
        build.dpo_ids(rows, "codepoint", malformed="raise").collect()
    kind = "array<struct<role:string,content:string>>"
    talk = spark.createDataFrame([(1, [("system", "s"), ("user", "p")], [("assistant", "c"), ("assistant", None)], [("assistant", "r")])], f"record_id long, prompt {kind}, chosen {kind}, rejected {kind}")
    one_row = build.dpo_ids(talk, "codepoint").first()
    assert "".join(map(chr, one_row.chosen)) == "<|im_start|>system\ns<|im_end|>\n" + text
    assert build.dpo_ids(rows.limit(0), "codepoint").count() == 0


def test_a_record_that_fails_is_left_out_alone():
    from tokenmill.operators.tokenize import Special, each_apart, sentinel_ids

    def run(items):
        return [len(x) if x != "bad" else 1 / 0 for x in items]

    assert each_apart(run, ["a", "bad", "ccc"]) == [1, None, 3] and each_apart(run, []) == []
    special = Special({"pad": "<p>", "eos": "<e>"}, {"<p>": 5, "<e>": 6})
    assert sentinel_ids(lambda t: [ord(c) for c in t], "ab", special) == [97, 98]
    assert sentinel_ids(lambda t: [], "x", special) == [5] and sentinel_ids(lambda t: [], None, Special()) == [0]


def test_jsonl_stores(spark, tmp_path):
    from tokenmill.sources import records

    (tmp_path / "b.jsonl").write_text('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}\n\nnot json\n', encoding="utf-8")
    (tmp_path / "a.jsonl").write_text('{"messages": [{"role": "assistant", "content": "first"}]}\n', encoding="utf-8")
    (tmp_path / "x.txt").write_text("no", encoding="utf-8")
    schema = "messages array<struct<role:string,content:string>>"
    rows, bad = records.read_lines(spark, str(tmp_path), schema)
    assert [(r.record_idx, r.messages[0].content) for r in rows.orderBy("record_idx").collect()] == [(0, "first"), (1, "q")] and bad.count() == 1
    with pytest.raises(ValueError):
        records.jsonl_store(spark, str(tmp_path), schema)
    with pytest.raises(FileNotFoundError):
        records.jsonl_store(spark, str(tmp_path / "none"), schema)
    store_ = records.STORES.get("jsonl")(spark, str(tmp_path), schema, tokenizer="codepoint")
    assert store_.num_records == 2 and set(store_.keys) == {"sequence", "loss_mask", "position_ids"}
    whole = [x for i in range(2) for x in store_.fetch_record(i, "sequence")]
    n = store_.length("sequence")
    assert n == len(whole) and store_.fetch(0, n, "sequence") == whole and store_.fetch(3, 3, "sequence") == [] and store_.fetch(20, n - 5, "sequence") == whole[20 : n - 5]
    assert store_.fetch_record(-1, "sequence") == store_.fetch_record(1, "sequence")
    for wrong in ((-1, 2), (n, n), (0, n + 1)):
        with pytest.raises(ValueError):
            store_.fetch(*wrong, "sequence")
    with pytest.raises(IndexError):
        store_.fetch_record(2)
    with pytest.raises(KeyError):
        store_.fetch_record(0, "nothing")
    with pytest.raises(RuntimeError):
        records.RecordStore().num_records
    lazy = records.jsonl_store(spark, str(tmp_path), schema, processor=lambda df: df.select(F.transform("messages", lambda m: F.length(m["content"])).alias("sizes")))
    assert lazy.fetch_record(0)["sizes"] == [5] and lazy.keys == ["sizes"]
    with pytest.raises(RuntimeError):
        lazy.length("sizes")
    (tmp_path / "dataset_config.json").write_text(json.dumps(corpus.CHAT_CONFIG.to_dict() | {"preprocessing": {"max_seq_len": 4}}), encoding="utf-8")
    assert len(records.jsonl_store(spark, str(tmp_path), schema).fetch_record(0, "sequence")) == 4


def test_arrays_and_lines_in_one_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n\n', encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text('{"x": 4}\n', encoding="utf-8")
    for mode in ("fail", "skip"):
        assert sorted(r.x for r in json_files.read_records(spark, str(tmp_path), "x int", mode).collect()) == [1, 2, 3, 4]
    assert sorted(r.x for r in json_files.read_records(spark, str(tmp_path), "x int", recursive=False).collect()) == [1, 2, 3]


def test_choice_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Question,A,B,C,D,Answer\n " 1 + 1? ",A)one,B) two,(C) three,d)four, b \nshort,1,2\n"q, with comma",A,B,,D,A\n', encoding="utf-8")
    got = [tuple(r) for r in json_files.read_choices(spark, str(tmp_path)).collect()]
    assert got[-1] == ("q, with comma", "A", "B", "", "D", "A") and got[0][1:] == ("one", "two", "(C) three", "d)four", "b") and len(got) == 2


def test_rollouts(spark):
    from tokenmill.operators import rollout

    class Length(rollout.RewardModel):
        def score(self, prompts, responses):
            return [[len(x) for x in r] for r in responses]

    rollout.REWARDS.register("length")(Length) if not rollout.REWARDS.is_registered("length") else None
    df = spark.createDataFrame([(1, "p", ["a", "bbb"]), (2, "p", None), (3, None, [None])], "row long, p string, r array<string>")
    assert {r.row: r.rewards for r in rollout.score_responses(df, "length", "p", "r").collect()} == {1: [1.0, 3.0], 2: None, 3: [0.0]}
    with pytest.raises(TypeError):
        rollout.REWARDS.register("wrong")(dict)
    assert [r.member for r in rollout.expand_groups(spark.range(1), 3).collect()] == [0, 1, 2]
    kind = "batch int, key int, prompts array<int>, responses array<array<int>>, logprobs array<array<double>>"
    rows = spark.createDataFrame([(0, 1, [5], [[1, 2], []], [[-1.0, -2.0], []]), (0, 2, [6, 7], [[3], [4]], [[-3.0], [-4.0]])], kind)
    got = {r.key: r for r in rollout.collate_rollouts(rows, "batch", "key").collect()}
    assert (got[1].prompts, got[1].prompt_mask, got[1].responses, got[1].response_mask[1], got[1].logprobs_old[1]) == ([0, 5], [False, True], [[1, 2], [0, 0]], [False, False], [0.0, 0.0])
    assert rollout.collate_rollouts(spark.createDataFrame([(0, 1, [5], [[]], [[]])], kind), "batch", "key").first().responses == [[0]]
    for wrong in ([(0, 1, [5], [[1]], [[]])], [(0, 1, [5], [[1]], [[0.0]]), (0, 2, [5], [[1], [2]], [[0.0], [0.0]])]):
        with pytest.raises(Exception, match="differ"):
            rollout.collate_rollouts(spark.createDataFrame(wrong, kind), "batch", "key").collect()
    bins = rollout.pair_bins(spark.createDataFrame([(1, [1] * 5, [1] * 3), (2, [1], [1]), (3, [1] * 2, [])], "k int, c array<int>, r array<int>").withColumn("g", F.lit(0)), "k", "c", "r", 10, ["g"])
    assert {r.k: r.bin for r in bins.collect()} == {1: 0, 2: 0, 3: 1}
    counts = spark.createDataFrame([([1, 2, 2, 3], [3, 9])], "p array<int>, o array<int>").select(rollout.recent_counts(F.col("p"), F.col("o"), 2).alias("c")).first().c
    assert counts == {2: 1, 3: 2, 9: 1}
    ce = spark.createDataFrame([([-1.0, -2.0], [-3.0, -3.0], [1, 0])], "l array<double>, m array<double>, k array<int>")
    assert ce.select(rollout.token_cross_entropy(F.col("l"), F.col("m"), F.col("k"), 0.1).alias("x")).first().x == pytest.approx(0.9 + 0.3)
    assert ce.select(rollout.token_cross_entropy(F.col("l"), F.col("m")).alias("x")).first().x == 1.5


def test_small_parts(spark):
    assert one(spark, text.block_text(F.col("t")), t='[{"type": "image"}, {"type": "text", "text": "hi"}]') == "hi"
    assert one(spark, text.block_text(F.col("t")), t="[plain]") == "[plain]" and spark.range(1).select(text.block_text(F.lit(None).cast("string")).alias("t")).first().t == ""
    df = spark.createDataFrame([([], [1, 2], None), (None, None, [1])], "a array<int>, b array<int>, m array<int>")
    assert [r.p for r in df.select(build.first_ids(["a", "b", "m"]).alias("p")).collect()] == [[1, 2], [1]]
    assert build.filled_up(df.filter("b is not null"), "b", ["m"]).first().m == [0, 0]
    assert pack.PACKERS.list_registered() == ["bfd", "bfd_split", "simple"]
    with pytest.raises(ValueError):
        scans.position_ids(F.col("x"), "odd")
