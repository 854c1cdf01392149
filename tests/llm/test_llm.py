import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenmill.llm import bpe, budget, chunks, containers, encode, leakage, mixing, neardup, pairs, pii, queries

TEXT = "id long, text string, ids string, item_id string, row string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], TEXT)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 30000), (5, "a" * 3000), (6, "same text here"), (6, "same text here"), (7, "Ünï © 漢字 👩‍💻 é́")]


# --- 7: encoding
def test_encode_equals_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encode.BYTE_BPE)
    tok.encode_special_tokens = True
    r = random.Random(1)
    extra = ["".join(r.choice("ab zé漢\n  '’s9.,<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(400)]
    rows = ODD + [(100 + i, t) for i, t in enumerate(extra)]
    got = sorted((x.id, x.ids) for x in encode.encode_corpus(texts(spark, rows), "id", "text").collect())
    want = sorted((i, tok.encode(t, add_special_tokens=False).ids if t else []) for i, t in rows)
    assert got == want
    assert encode.encode_corpus(texts(spark, []), "id", "text").count() == 0


def test_long_word_equals_short_path():
    enc = bpe.RankArrayEncoder(encode.BYTE_BPE)
    for w in ("abab" * 40, "the" * 50, "é" * 80):
        assert enc._long(w.encode()).tolist() == enc._rows([w.encode()])[0].tolist()


# --- 8: containers
def brute_pack(sizes, capacity, open_bins):
    free, closed, out, n = [], [], [], 0
    for s in sizes:
        fit = [b for b in free if b[0] >= s]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            if len(free) == open_bins:
                free.remove(min(free, key=lambda b: b[0]))
            b = [capacity, n]
            n += 1
            free.append(b)
        b[0] -= s
        out.append(b[1])
        if not b[0]:
            free.remove(b)
    return out


def test_open_bins_equal_brute_force():
    r = random.Random(4)
    for _ in range(30):
        sizes = [r.randint(1, 50) for _ in range(200)]
        bins = containers.OpenBins(50, 5)
        mine = [bins.add(s) for s in sizes]
        theirs = brute_pack(sizes, 50, 5)
        use = lambda a: [sum(s for s, b in zip(sizes, a) if b == k) for k in sorted(set(a))]
        assert max(use(mine)) <= 50 and len(set(mine)) == len(set(theirs))


def test_pack(spark):
    rows = [(1, 5), (2, None), (3, 0), (4, 250), (5, 60), (5, 60), (6, 100)]
    got = containers.pack(spark.createDataFrame(rows, "id long, n int"), "id", "n", capacity=100, open_bins=3).collect()
    by = {}
    for x in got:
        by.setdefault(x.container, []).append(x.used)
    assert all(sum(v) <= 100 for k, v in by.items() if k is not None)
    assert sorted(x.id for x in got if x.container is None) == [2, 3]
    assert [x.used for x in sorted(got, key=lambda x: x.part) if x.id == 4] == [100, 100, 50]
    assert sum(x.used for x in got) == 475 and len(got) == 9
    assert containers.pack(spark.createDataFrame([], "id long, n int"), "id", "n").count() == 0
    with pytest.raises(ValueError):
        containers.pack(spark.createDataFrame(rows, "id long, n int"), "id", "n", capacity=0)


# --- 6: pieces
def test_pieces_round_trip(spark):
    r = random.Random(2)
    rows = [(1000 + i, "".join(r.choice(["word ", "Ende. ", "\n\n", "漢字。", "x", "\n"]) for _ in range(r.randint(0, 400)))) for i in range(60)] + ODD
    got = chunks.split_oversized(texts(spark, rows), "id", "text", limit=120, overlap=20).collect()
    for i, t in rows:
        mine = sorted((x for x in got if x.id == i), key=lambda x: (x.piece, x.start_char))
        if t is None or len(t) <= 120:
            assert not mine
        elif i != 6:
            assert "".join(x.text[x.overlap :] for x in mine) == t
            assert all(len(x.text) <= 120 for x in mine)
            assert all(b.text[: b.overlap] == a.text[-b.overlap :] for a, b in zip(mine, mine[1:]))
            assert all(x.overlap == min(20, x.start_char + x.overlap) for x in mine[1:])
    with pytest.raises(ValueError):
        chunks.split_oversized(texts(spark, rows), "id", "text", limit=10, overlap=10)


def test_pieces_cut_at_boundaries():
    text = ("A sentence of some words here. " * 20 + "\n\n") * 3
    for _, _, end in chunks.pieces(text, 700, 50)[:-1]:
        assert text[end - 1] in " \n"
    assert [e for _, _, e in chunks.pieces("x" * 100, 40, 10)][-1] == 100


# --- 5: leakage
def test_fm_index_against_brute_force():
    r = np.random.default_rng(0)
    for _ in range(20):
        runs = [r.integers(1, 4, r.integers(1, 40)) for _ in range(10)]
        seq = np.concatenate([np.concatenate([x, [0]]) for x in runs])
        index = leakage.FMIndex(seq, 4, sample=4)
        phrases = r.integers(1, 4, (30, 4))
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(len(seq) - 3) if (seq[i : i + 4] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks(spark):
    q = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen."
    items = spark.createDataFrame([(9, q), (10, "too short"), (11, None)], "item_id long, question string")
    rows = ODD + [(20, "Intro İ " + q.upper().replace(" ", " - ") + " end"), (21, " ".join(q.split()[:11])), (22, "x " + " ".join(q.split()[1:13]) + " y"), (22, "x " + " ".join(q.split()[1:13]) + " y")]
    found = leakage.find_leaks(texts(spark, rows), "id", "text", items)
    assert {(x.id, x.item_id) for x in found.collect()} == {(20, 9), (22, 9)}
    got = {x.id: (x.start_char, x.end_char, x.n_tokens) for x in found.collect()}
    text = dict(rows)[20]
    assert text[got[20][0] : got[20][1]] == q.upper().replace(" ", " - ").rstrip(".") and got[20][2] == 14
    assert leakage.removal_spans(found, "id").count() == 2 and leakage.leaked_pairs(found, "id").count() == 2
    assert leakage.find_leaks(texts(spark, []), "id", "text", items).count() == 0
    assert leakage.find_leaks(texts(spark, rows), "id", "text", items.limit(0)).count() == 0


def test_removal_spans_of_both_corpora(spark, tmp_path):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen"
    spark.createDataFrame([(9, q)], "item_id long, question string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(1, f"see {q}"), (2, "clean"), (3, None)], "record_id long, text string").write.parquet(f"{tmp_path}/pretrain.parquet")
    asked = [(1, f"now say {q}", None), (1, f"now say {q}", None), (2, None, f"{q}!"), (3, "clean", q), (4, None, None)]
    spark.createDataFrame(asked, "record_id long, prompt string, legacy_input string").write.parquet(f"{tmp_path}/dpo_tokenize.parquet")
    got = sorted(tuple(x) for x in queries.p5_spans(spark, str(tmp_path)).select("corpus", "record_id", "start_char", "end_char").collect())
    assert got == [("dpo_tokenize", 1, 8, 8 + len(q)), ("dpo_tokenize", 2, 0, len(q)), ("pretrain", 1, 4, 4 + len(q))]


# --- 1: near-duplicates
def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(r.randint(0, 3)):
            edited = list(base)
            for _ in range(r.randint(0, len(base) // 12)):
                edited[r.randrange(len(edited))] = r.choice(vocab)
            rows.append((len(rows), " ".join(edited)))
    return rows


def jaccard(a, b, k):
    x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (leakage.tokens(a or ""), leakage.tokens(b or "")))
    return len(x & y) / len(x | y) if x and y else 0.0


def test_runs_of_joined_marks_are_cut_in_time():
    import time

    t, text = time.time(), "e" + "\u0301" * 60_000
    cut = chunks.pieces(text, 2000, 200)
    assert "".join(text[own:end] for _, own, end in cut) == text and max(e - s for s, _, e in cut) <= 2000 and time.time() - t < 5
    assert chunks.pieces("e\u0301" * 100, 40, 0)[0][2] % 2 == 0


@pytest.mark.parametrize("hot, sketched", [(4096, True), (3, True), (4096, False)])
def test_near_duplicates_equal_brute_force(spark, hot, sketched):
    rows = corpus() + [(900, None), (901, ""), (902, "a b"), (903, "one two three four"), (904, "one two three four"), (904, "one two three four")]
    links, members = neardup.near_duplicates(texts(spark, rows), "id", "text", k=3, threshold=0.6, hot=hot, sketched=sketched)
    got = {(x.id_a, x.id_b) for x in neardup.all_pairs(links, members).collect()}
    one = dict(rows)
    want = {(a, b) for a in one for b in one if a < b and jaccard(one[a], one[b], 3) >= 0.6}
    assert got == want
    if hot == 4096:
        classes = {x.id: x.class_id for x in neardup.duplicate_classes(links, members).collect()}
        assert all(classes[a] == classes[b] for a, b in want) and classes[904] == 903
        assert len(classes) == len({i for i, t in one.items() if len(leakage.tokens(t or "")) >= 3})


def test_classes_of_both_corpora(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    near = base[:50] + [f"x{i}" for i in range(8)]  # 48 of 66 runs: between 0.6 and 0.8
    talk = [f"t{i}" for i in range(40)]
    assert 0.6 < jaccard(" ".join(base), " ".join(near), 3) < 0.8
    pretrain = [(5, " ".join(base)), (7, " ".join(near)), (8, "nothing like the others here"), (8, "nothing like the others here"), (9, None)]
    rollout = [(2, [("user", " ".join(talk[:20])), ("assistant", " ".join(talk[20:]))]), (3, [("user", " ".join(talk)), ("assistant", None)]), (4, [("user", " ".join(base))]), (6, None)]
    spark.createDataFrame(pretrain, "record_id long, text string").write.parquet(f"{tmp_path}/pretrain.parquet")
    spark.createDataFrame(rollout, "rollout_id long, messages array<struct<role string, content string>>").write.parquet(f"{tmp_path}/rollout.parquet")
    rows = queries.p1_classes(spark, str(tmp_path)).collect()
    got = {(x.corpus, x.record_id): (x.class_corpus, x.class_id) for x in rows}
    assert len(rows) == len(got)
    assert got == {
        ("pretrain", 5): ("pretrain", 5), ("pretrain", 7): ("pretrain", 5), ("rollout", 4): ("pretrain", 5), ("pretrain", 8): ("pretrain", 8),
        ("rollout", 2): ("rollout", 2), ("rollout", 3): ("rollout", 2),
    }


def test_near_duplicates_of_nothing(spark):
    links, members = neardup.near_duplicates(texts(spark, []), "id", "text")
    assert links.count() == 0 and members.count() == 0


def test_prob_minhash_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:200], r.integers(0, 1 << 62, 100).astype(np.uint64)])
    m = 1024
    s = neardup.prob_minhash(np.concatenate([a, b]), np.array([300, 300]), m)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.06
    w = np.concatenate([np.where(np.arange(300) < 200, 5.0, 1.0)] * 2)
    s = neardup.prob_minhash(np.concatenate([a, b]), np.array([300, 300]), m, w)
    both = neardup._weighted(np.stack([np.sort(a), np.where(np.isin(np.sort(a), a[:200]), 5, 1).astype(np.uint64)], 1), np.stack([np.sort(b), np.where(np.isin(np.sort(b), a[:200]), 5, 1).astype(np.uint64)], 1))
    assert abs((s[0] == s[1]).mean() - both) < 0.06


# --- 3: mixing
def test_min_cost_flow_prefers_cheap():
    assert mixing.min_cost_flow(3, [(0, 2, 5, 3), (0, 2, 5, 1), (2, 1, 7, 0)], 0, 1) == [2, 5, 7]


def test_overlapping_sources_share_records():
    flow = mixing.route({"a": (["a"], 100), "ab": (["a", "b"], 100)}, {"a": (0.5, 1), "b": (0.5, 1)}, 200)
    assert flow == {("a", "a"): 100, ("ab", "b"): 100}


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["web", "WEB ", "web", "code", None]), [1] * r.randint(1, 50)) for i in range(4000)]
    rows += [(9000 + i, "tiny", [1] * 20) for i in range(5)] + [(i, d, s) for i, d, s in rows[:50]] + [(9990, "web", None), (None, "web", [1])]
    records = spark.createDataFrame(rows, "record_id long, domain string, sequence array<int>")
    targets = spark.createDataFrame([("web", 0.6, 1), ("code", 0.35, 2), ("tiny", 0.05, 3), ("none", 0.0, 1)], "domain string, target_share double, max_repeats int")
    for total in ("reachable", 3000, "corpus"):
        taken, plan = mixing.mix(records, targets, total_tokens=total)
        assert taken.groupBy("record_id").agg(F.sum("uses").alias("u"), F.first("domain").alias("d")).filter("u > case d when 'web' then 1 when 'code' then 2 else 3 end").count() == 0
        report = {x.domain: x for x in mixing.mix_report(taken, plan, targets).collect()}
        assert set(report) == {"web", "code", "tiny", "none"} and report["none"].tokens == 0
        if total == "reachable":
            assert all(abs(report[d].actual_share - s) < 0.02 for d, s in (("web", 0.6), ("code", 0.35), ("tiny", 0.05)))
        if total == "corpus":
            assert report["tiny"].tokens == 300 < report["tiny"].quota
    taken, plan = mixing.mix(records.limit(0), targets)
    assert taken.count() == 0 and plan.total == 0


# --- 4: budget
def test_budget_by_deltas(spark):
    schema = "record_id long, text string, source string, domain string, hash string"
    first = [(1, "one two", "s", "d", "x"), (1, "one two", "s", "d", "x"), (2, None, None, "d", "x"), (3, "", "s", "d", "x"), (None, "no id", "s", "d", "x"), (4, "gone soon", "t", "d", "x")]
    second = [first[0], first[2], (3, "now it has text", "s", "d", "x"), (5, "one two", "t", "e", "x")]
    kept = budget.TokenBudget("record_id", "text", ["source", "domain"])
    kept.update(spark.createDataFrame(first, schema))
    got = kept.update(spark.createDataFrame(second, schema)).collect()
    fresh = budget.TokenBudget("record_id", "text", ["source", "domain"]).update(spark.createDataFrame(second, schema)).collect()
    assert sorted(map(str, got)) == sorted(map(str, fresh)) and kept.encoded == 1
    assert kept.update(spark.createDataFrame([], schema)).count() == 0
    assert budget.TokenBudget("record_id", "text", ["source"]).update(spark.createDataFrame([], schema)).count() == 0


def test_budget_outlives_its_session(spark, tmp_path):
    schema, path = "record_id long, text string, source string", str(tmp_path / "state")
    make = lambda: budget.TokenBudget("record_id", "text", ["source", "domain"], path=path)
    domain = lambda rows: budget.domains(rows, spark.createDataFrame([(1, "A "), (1, "a")], "record_id long, domain string"), "record_id")
    first = spark.createDataFrame([(1, "one two", "s"), (2, "one two", "s"), (3, "three", None)], schema)
    kept = make()
    assert kept.open(spark) is None
    got = {(r.source, r.domain): (r.records, r.tokens) for r in kept.update(first, domain(first)).collect()}
    assert got == {("s", "a"): (1, 2), ("s", "__default__"): (1, 2), (None, "__default__"): (1, 1)} and kept.encoded == 2  # copies once
    again = make()
    assert sorted(map(str, again.open(spark).collect())) == sorted(map(str, kept._shown().collect()))
    for text, encoded in (("one two", 0), ("new words here", 1), ("three", 0)):
        second = spark.createDataFrame([(1, text, "s")], schema)
        later = make()
        assert later.update(second, domain(second)).count() == 1 and later.encoded == encoded
    assert later.version == 4 and sorted(x.name for x in (tmp_path / "state").iterdir()) == ["v3", "v4"]
    (tmp_path / "state" / "v4" / "done").unlink()  # a version that was broken off doesn't count
    assert make().open(spark).collect()[0].tokens == 3


def test_domain_counts_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "record_id long, domain string")
    built = spark.createDataFrame([(1, " WEB"), (1, "web "), (3, "x")], "record_id long, domain string")
    assert {tuple(x) for x in budget.domains(rows, built, "record_id").collect()} == {(1, "web"), (2, "__default__")}


# --- 2: pairs
LONG = "The first shard is read before the second one is opened. Then the loader waits for the mask, because both sides round differently."
CASES = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("<|im_start|>assistant\n<|im_end|>", "empty"), ("...", "empty"),
    (LONG, None), ("Yes", None), ("42", None), ("int32", None), ("max_seq_len", None), (LONG + " ✅", None), (LONG + "\n```python\nreturn 1\n```", None),
    (LONG[:100], "truncated"), (LONG + "\n```python\nreturn", "truncated"), (LONG + '\n{"a": [1,', "truncated"),
    ("I'm sorry, but I can't help with that. Please consult an expert instead.", "refusal"), ("对不起，我不能提供相关内容。", "refusal"), ("Leider kann ich dazu keine Auskunft geben.", "refusal"),
    ("I'm sorry you ran into this. " + LONG, None), ('A refusal such as "I cannot help with that" would be wrong here. ' + LONG, None),
    ("Why does the nested loader wait for the second shard?", "copy"), ("Question: Why does the nested loader wait for the second shard?", "copy"), ("Why does the nested loader wait for the second shard?\n\n" + LONG, None),
    ("Der Lader wartet auf die zweite Scherbe, weil die Maske noch nicht fertig ist und niemand die Warteschlange leert.", "language"),
    ("Sure! Der Lader wartet auf die zweite Scherbe, weil die Maske noch nicht fertig ist und niemand die Warteschlange leert.", "language"),
]


def test_pairs(spark):
    prompt = "Why does the nested loader wait for the second shard?"
    rows = [(i, None if i % 2 else prompt, prompt if i % 2 else None, LONG, a) for i, (a, _) in enumerate(CASES)] * 2
    df = spark.createDataFrame(rows, "record_id long, prompt string, legacy_input string, chosen string, rejected string")
    got = {(x.record_id, x.side): x.defect for x in pairs.single_defect(pairs.defective_pairs(df)).collect()}
    assert got == {(i, "rejected"): d for i, (_, d) in enumerate(CASES) if d}
    assert pairs.defective_pairs(df.limit(0)).count() == 0


def test_functions_disagree_and_the_model_decides():
    """Only one function sees this refusal by its phrase, and only one doubts this answer."""
    prompt = "Why does the nested loader wait for the second shard?"
    unnamed = pairs.vote_pair(prompt, ["Sorry, that is not something I do here at all, and we do not talk about it.", LONG])[0][0]["refusal"]
    assert unnamed[0] == pairs.FINE and unnamed.count(pairs.DEFECT) >= 2
    doubted = pairs.vote_pair(prompt, ["Sure, " + prompt + " " + LONG, LONG])[0][0]["copy"]
    assert 0 < doubted.count(pairs.DEFECT) < 4
    assert {d: len(v) for d, v in pairs.vote_pair("", ["x", None])[0][0].items()} == pairs.FUNCTIONS


def test_parts_of_refusals():
    for text in ("I can't.", "we won't", "I am unable to", "I am not allowed", "I must decline", "we have to pass", "I do not feel", "I’m not able", "unable to help", "kann ich dir nicht", "ich darf keine", "ich muss ablehnen", "ich bin außerstande",
                 "nicht in der Lage", "keine Auskunft geben", "nicht helfen", "je ne peux", "je dois refuser", "je dois décliner", "je refuse", "ne suis pas en mesure", "pas autorisé", "no puedo", "no estoy autorizado", "no me es posible", "no podré", "debo rechazar", "debo declinar", "me niego", "不能回答", "无法提供", "没有办法回答", "不便讨论", "恕难", "拒绝回答"):
        for t in (text, text.upper()):
            assert pairs.refuses(t) == bool(pairs.REFUSES.search(t)), t
        assert pairs.refuses(text), text


def test_label_model_and_cutoffs():
    r = random.Random(0)
    seen = {}
    for _ in range(4000):
        y = r.random() < 0.1
        p = tuple((1 if y else 0) if r.random() < acc else (0 if y else 1) for acc in (0.95, 0.9, 0.8))
        seen[p] = seen.get(p, 0) + 1
    post = pairs.fit_label_model(seen)
    assert post[1, 1, 1] > 0.9 and post[0, 0, 0] < 0.05 and post[1, 1, 0] > post[0, 0, 1]
    assert pairs.validate_cutoffs([("copy", 0.8, True, 1.0), ("copy", 0.6, False, 1.0), ("copy", 0.1, False, 1.0)])["copy"] == 0.7


def test_cutoffs_come_from_all_records(spark, monkeypatch):
    """Every record with a chosen answer of some length is in the validation once: beyond 1,500 of them, and with a text over 20,000 characters."""
    prompts = ["Why does the nested loader wait for the second shard?", "Warum wartet der Lader auf die zweite Scherbe und nicht auf die Maske?"]
    answers = [LONG, "Der Lader wartet auf die zweite Scherbe, weil die Maske noch nicht fertig ist und niemand die Warteschlange leert."]
    rows = [(i, prompts[i % 2], None, answers[i % 2] if i % 8 else "Yes", answers[i % 2]) for i in range(2000)]
    rows += [(i, prompts[0], None, LONG * 200, LONG) for i in range(2000, 2004)]
    df = spark.createDataFrame(rows + rows[:100], "record_id long, prompt string, legacy_input string, chosen string, rejected string")
    seen, validate = [], pairs.validate_cutoffs
    monkeypatch.setattr(pairs, "validate_cutoffs", lambda scored: seen.append(scored) or validate(scored))
    for parts in (1, 5):
        pairs.defective_pairs(df.repartition(parts))
    for scored in seen:
        assert {d: sum(w for name, _, truth, w in scored if name == d and not truth) for d in pairs.DEFECTS} == dict.fromkeys(pairs.DEFECTS, 1754)
        assert {name for name, _, truth, _ in scored if truth} == set(pairs.DEFECTS)
    assert seen[0] == seen[1]


def test_planted_defects_are_voted_like_answers():
    """The patterns of made defects are those that the functions give for the made answers, the exchange those of all pairs of records."""
    rows = [
        (1, "Why does the nested loader wait for the second shard?", LONG, "Der Lader wartet auf die Maske, weil die zweite Scherbe nicht fertig ist."), (2, "Why is that?", LONG[20:], None),
        (3, "Warum wartet der Lader auf die zweite Scherbe?", "Der Lader wartet auf die zweite Scherbe, weil die Maske noch nicht fertig ist und niemand die Warteschlange leert.", LONG),
        (4, "Pourquoi est-ce que le chargeur attend la suite ?", "Le chargeur attend la suite, parce que le masque n'est pas encore là et que personne ne vide la file.", "Oui."),
        (5, "", "0x1f 0x2f 0x3f " * 8, "..."), (6, "请说明这个表。", "." * 90, "好的，这个表说明了每个分片的位置。"), (7, "Explica la tabla de los datos.", "." * 90, LONG),
    ]
    parts, wanted = Counter(), Counter()
    wants = [pairs.expected_language(p) for _, p, _, _ in rows]
    for i, (id_, prompt, chosen, other) in enumerate(rows):
        got, key = pairs.planted(id_, pairs.Judged(prompt, [chosen, other]), chosen, other)
        ways = {
            "empty": pairs.EMPTIED, "refusal": pairs.DECLINED[wants[i] or "en"], "copy": [prompt, prompt + "\n", f"> {prompt}"],
            "truncated": [chosen[:n].rstrip() for n in range(int(0.3 * len(chosen)), int(0.95 * len(chosen)) + 1)],
        }
        for d, made in ways.items():
            voted = [pairs.vote_pair(prompt, [x, other])[0] for x in made]
            assert d not in got and d == "truncated" or (got[d], key if d == "truncated" else None) in [("".join(map(str, v[d])), k if d == "truncated" else None) for v, k in voted], (id_, d)
        parts.update(got["language"].split() if "language" in got else [])
        wanted.update(tuple(pairs.vote_pair(prompt, [x[2], other])[0][0]["language"]) for x, w in zip(rows, wants) if wants[i] and w and w != wants[i])
    assert pairs.exchanged(parts) == wanted and len(wanted) > 3


@pytest.mark.parametrize("text, lang", [("Explain the map. Antworte auf Spanisch.", "es"), ("What is the role of the mask? Please reply in German only.", "de"), ("请说明这个表。", "zh"), ("Qu'est-ce que le masque et pourquoi est-il lent ?", "fr")])
def test_expected_language(text, lang):
    assert pairs.expected_language(text) == lang


# --- 9: personal information
def test_pii_held_out_accuracy():
    from tokenmill.llm.pii_training import examples

    model = pii.SemiMarkovCRF.load()
    good = bad = missed = 0
    for text, gold in examples(600, seed=1234):
        got = {(s, k) for s, _, k in model.decode(text)}
        good += len(got & set(gold))
        bad += len(got - set(gold))
        missed += len(set(gold) - got)
    assert good / (good + bad) > 0.96 and good / (good + missed) > 0.94


@pytest.mark.parametrize("lang, recall", [("en", 0.8), ("de", 0.8), ("fr", 0.8), ("es", 0.8), ("zh", 0.65)])
def test_names_and_sentences_not_in_training(lang, recall):
    """Ordinary names in sentences of their own; see the README for what is missed."""
    from tests.llm.pii_held_out import NOBODY, cases

    model = pii.SemiMarkovCRF.load()
    good = bad = missed = 0
    for text, gold in cases(lang):
        got = {(s, k) for s, _, k in model.decode(text) if s >= len(NOBODY[lang])}
        good, bad, missed = good + len(got & gold), bad + len(got - gold), missed + len(gold - got)
    assert good / (good + bad) > 0.95 and good / (good + missed) > recall


def test_held_out_names_are_not_training_names():
    from tests.llm.pii_held_out import NAMES
    from tokenmill.llm import pii_training

    known = {g for lang in pii_training.GIVEN.values() for g in lang.split()}, {f for lang in pii_training.FAMILY.values() for f in lang.split()}
    for lang in ("en", "de", "fr", "es"):
        for name in NAMES[lang].split(","):
            given, family = name.split(" ")
            assert given not in known[0] and family not in known[1], name


def test_pii_decode_is_the_best_labelling():
    """Against all sets of segments that don't overlap."""
    from itertools import combinations

    model = pii.SemiMarkovCRF.load()
    text = "Deliver to Ingrid Halov, 85 Elm St., or ring +1-919-555-0122."
    found = [(s, e, k, model.score(f)) for s, e, k, f in pii.candidates(text)]
    best = max((c for n in range(len(found) + 1) for c in combinations(found, n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in combinations(c, 2))), key=lambda c: sum(x[3] for x in c))
    assert sorted((s, e, k) for s, e, k, _ in best) == model.decode(text)


def test_pii_on_rows(spark):
    rows = ODD + [(30, "Mail ana.falov@example.org, see pass@10 and pkg@1.2.3.\nSigned, Ingrid Halov"), (31, "联系人：臧疏，电话199-5550-0115。")]
    found = pii.find_mentions(texts(spark, rows), "id", "text").collect()
    assert {(x.id, x.kind, x.start_char) for x in found} == {(30, "email", 5), (30, "name", 63), (31, "name", 4), (31, "phone", 9)}
    masked = {x.id: x.text for x in pii.mask(texts(spark, rows), "id", "text").collect()}
    assert masked[30] == "Mail [EMAIL], see pass@10 and pkg@1.2.3.\nSigned, [NAME]" and masked[31] == "联系人：[NAME]，电话[PHONE]。"
    assert masked[1] is None and masked[2] == "" and masked[7] == dict(rows)[7]
    assert pii.find_mentions(texts(spark, []), "id", "text").count() == 0


@pytest.mark.parametrize("text", ["12 Rue Victor Hugo", "7 av. Foch", "Kurfürstendamm 21", "Paul-Lincke-Ufer 5", "Halleschesufer 5", "Pza. Mayor 3", "Travesía Luna 4", "calle Mayor 3"])
def test_no_gate_hides_an_address(text):
    shapes = (pii.ADDRESS_DE, pii.ADDRESS_FR, pii.ADDRESS_ES)
    want = {m.span() for shape in shapes for m in shape.finditer(text)}
    assert want <= {(s, e) for s, e, kind, _ in pii.candidates(text) if kind == "address"}
    assert want


def test_crf_marginals_sum():
    model = pii.SemiMarkovCRF({"a": 1.0, "b": 0.5})
    p = model.marginals([(0, 3, ["a"]), (2, 5, ["b"])])
    z = 1 + np.exp(1.0) + np.exp(0.5)
    assert np.allclose(p, [np.exp(1.0) / z, np.exp(0.5) / z])


def test_regular_expressions_stay_linear():
    import time

    t = time.time()
    pii.candidates("A. " * 20000), pii.candidates("1" * 20000), pii.candidates("a@" * 5000)
    pii.candidates("Aa " * 20000), pii.candidates("张三" * 20000)
    assert time.time() - t < 20


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_budget_in_two_steps_equals_one(spark):
    from tokenmill.llm import queries

    d = "/root/testdata/sf0.001"
    assert sorted(map(str, queries.p4_update(spark, d).collect())) == sorted(map(str, queries.p4_cube(spark, d).collect()))
