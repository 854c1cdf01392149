"""Broken prompt and response pairs by labelling functions and an EM label model (problem 2)."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import prompt_of, written
from tokenmill.llm.leakage import tokens

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")  # also the order in ties
ABSTAIN, FINE, DEFECT = 2, 0, 1

# --- fixed values: words and phrases ---------------------------------------------------------
STOPWORDS = {
    "en": "the of and to is in that it for on with as are this be by at an from or not which when because while but they we you can will should if than has have before after whenever so there does what why how".split(),
    "de": "der die das und ist nicht ein eine den dem des mit auf für im zu von bei nach vor wenn während aber weil dass wird sich auch als am zum zur wir sie es ich ohne seit denn nur noch keine ab".split(),
    "fr": "le la les des du de et est un une que qui dans pour pas sur avec au aux ce cette il elle nous vous par plus mais ou donc quand après avant sans depuis ne se sont être ont l d".split(),
    "es": "el la los las de del y es un una que en para no con por se su al lo más pero o como cuando desde hasta antes después sin sobre está son hay ya si porque entre mi tu".split(),
}
_OWN = {lang: frozenset(words) for lang, words in STOPWORDS.items()}
ASKED = {
    "en": r"\bEnglish\b|Englisch|\banglais\b|\binglés\b|英[文语]",
    "de": r"\bGerman\b|auf Deutsch|\ballemand\b|\balemán\b|德[文语]",
    "fr": r"\bFrench\b|Französisch|\bfrançais\b|\bfrancés\b|法[文语]",
    "es": r"\bSpanish\b|Spanisch|\bespagnol\b|\bespañol\b|西班牙[文语]",
    "zh": r"\bChinese\b|Chinesisch|\bchinois\b|\bchino\b|中文|汉语",
}
ASKED = {lang: re.compile(words) for lang, words in ASKED.items()}
ASKS = re.compile(r"(?i)\b(?:repl(?:y|ies)|answer|respond|response|written|write|antwort\w*|schreib\w*|répon\w+|rédige\w*|respond\w+|respuesta|escrib\w+|contest\w+)\b|回答|回复|作答|写")
REFUSES = re.compile(
    r"(?i)\b(?:I|we) (?:can(?:['’]t|not| not)|won['’]t|am (?:unable|not able|not allowed)|must decline|have to (?:pass|decline)|refuse|do not feel)|\bI['’]m (?:unable|not able|not allowed)|\bunable to (?:help|answer|assist)"
    r"|\b(?:kann|darf|möchte|werde) ich (?:\w+ ){0,4}(?:nicht|keine?n?)\b|\bich (?:kann|darf|muss|werde|bin) (?:\w+ ){0,6}(?:nicht|keine?n?|ablehnen|außerstande)\b|\bmuss ich ablehnen|nicht in der Lage|keine Auskunft geben|nicht (?:helfen|weiterhelfen|beantworten)"
    r"|\bje (?:ne (?:peux|suis|saurais|veux)|dois (?:refuser|décliner)|refuse)|ne suis pas en mesure|\bpas autorisé"
    r"|\bno (?:puedo|estoy autorizad\w|me es posible|podré)|\bdebo (?:rechazar|declinar)|\bme niego"
    r"|(?:我)?(?:不能|无法|没有办法|不便|恕我不能|恕不能|拒绝)(?:回答|作答|提供|协助|讨论|完成|帮助|满足)|恕我不能|恕难"
)
#: Every phrase of REFUSES holds one of these.
REFUSAL_PARTS = ("can't", "can’t", "cannot", "can not", "won't", "won’t", "unable", "not able", "not allowed", "declin", "refus", "to pass", "not feel", "nicht", "kein", "ablehn", "außerstande", "peux", "suis", "saurais", "veux", "déclin", "autoris", "puedo", "estoy", "posible", "podré", "rechaz", "niego", "能", "法", "便", "恕", "拒")
_ASCII_PARTS = tuple(p for p in REFUSAL_PARTS if p.isascii())
#: Said beside an answer: no refusal by themselves.
REFUSES_NOT = re.compile(r"(?i)certain|sure\b|ganz sicher|en être c|asegurar|完全确定|確定|such as|wie etwa|comme|como «|诸如|例如|\"|“|«|„|「|quote")
COURTESY = re.compile(
    r"(?i)^(?:(?:I['’]m |I am )?(?:very |so |really )?sorry\b|I apolog|unfortunately|thanks? (?:you )?for|as an? (?:AI|language)|please (?:consult|ask)|is there anything|feel free|I hope you|for safety|(?:es )?tut mir|leider|entschuldig|als (?:KI|sprachmodell)|danke|bitte wende|ich hoffe|gern|"
    r"(?:je suis )?désolé|malheureusement|en tant que|merci|n['’]hésitez|j['’]espère|veuillez|pardon|excus|lo siento|lamentablemente|disculpa|como modelo|gracias|puedes|espero que|consulta|por favor|很?抱歉|对不起|作为|感谢|请谅解|您可以|建议咨询|希望)"
)
PLACEHOLDER = re.compile(r"(?i)[\[(<{]*\s*(?:n\s?[/.]?\s?a\.?|no (?:response|answer|reply|content|output)|empty|blank|deleted|removed|todo|tbd|fixme|null|nil|undefined|missing|keine antwort|leer|vide|aucune réponse|vacío|sin respuesta|无|空|无回答|无内容|暂无|未填写|待补充)\s*[\])>}]*[.。:]?")
FENCE = re.compile(r"```.*?```|~~~.*?~~~", re.S)
QUOTED = re.compile(r"\"[^\"\n]{0,400}\"|“[^”]{0,400}”|«[^»]{0,400}»|„[^“”]{0,400}[“”]|「[^」]{0,400}」|`[^`\n]*`|\{[^{}]*\}|^>.*$", re.M)
QUOTES = "\"“«„「`{"
SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+|\n|$)")
LIST_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])\s+")
IDEOGRAPH = re.compile(r"[一-鿿]")
LATIN_WORDS = re.compile(r"[^\W\d_一-鿿]+")
NUMBER = re.compile(r"\d+")
#: Four words or six ideographs that aren't marks of a chat format: no need to look closer.
SOME_WORDS = re.compile(r"(?<![<|/\w])[^\W\d_]{2,}(?:[ ,;:'’-]+[^\W\d_]{2,}){3}|[一-鿿]{6}")


def visible(text: str) -> str:
    """Letters, digits, marks and signs: without blanks, control and format characters."""
    return "".join(c for c in text if unicodedata.category(c)[0] not in "ZC")


def quotes(text: str) -> bool:
    return '"' in text or "`" in text or "{" in text or ">" in text and (text[0] == ">" or "\n>" in text) or not text.isascii() and any(c in text for c in QUOTES)


def prose(text: str) -> str:
    """The text without code, quotations and lines that quote."""
    if "`" in text:
        text = FENCE.sub(" ", text)
        if "```" in text:
            text = text[: text.index("```")]
    return QUOTED.sub(" ", text) if quotes(text) else text


def language_scores(text: str) -> Counter:
    """Evidence for each language in characters of the sentences that show it."""
    out: Counter = Counter()
    for s in SENTENCE.findall(text):
        han = 0 if s.isascii() else len(IDEOGRAPH.findall(s))
        if han >= 2:
            out["zh"] += 3 * han
        words = LATIN_WORDS.findall(s.lower())
        if not words:
            continue
        hits = {lang: sum(map(own.__contains__, words)) for lang, own in _OWN.items()}
        best = max(hits.values())
        if best and sum(v == best for v in hits.values()) == 1:
            lang = next(k for k, v in hits.items() if v == best)
            out[lang] += sum(map(len, words))
    return out


def expected_language(prompt: str) -> str | None:
    """The language asked for, else that of the prompt's own prose."""
    if ASKS.search(prompt):
        for s in reversed(SENTENCE.findall(prompt)):
            if len(s) < 90 and ASKS.search(s):
                found = [lang for lang, words in ASKED.items() if words.search(s)]
                if len(found) == 1:
                    return found[0]
    scores = language_scores(prose(prompt))
    return scores.most_common(1)[0][0] if scores else None


def end_key(text: str) -> str | None:
    """What stands before an end: the last two words, or the last four ideographs; numbers as 0."""
    text = text[-80:].lower().rstrip(" \t\"'”’)）」*_`")
    if "一" <= text[-1:] <= "鿿":
        return NUMBER.sub("0", text)[-4:]
    words = LAST_WORDS.match((COMPOUND.sub("-", text) if "-" in text else text)[::-1])
    return NUMBER.sub("0", f"{words[2][::-1]} {words[1][::-1]}") if words else None


LAST_WORDS, COMPOUND = re.compile(r"[^\w'’\-]*([\w'’\-]+)[^\w'’\-]+([\w'’\-]+)"), re.compile(r"\w+-(?=\w)")
INNER_END = re.compile(r"[.!?。！？\n](?:(?<=[.!?。！？])(?=\s|[一-鿿]|$)|(?<=[^\s.!?。！？]\n)(?=\s*(?:[-*•–]|\d+[.)])\s))")


def inner_ends(text: str) -> Iterator[str]:
    """Keys of all ends inside a text: before a full stop, and at the end of items that others follow."""
    for m in INNER_END.finditer(text):
        if m.start() > 2 and (key := end_key(text[max(0, m.start() - 80) : m.start()])):
            yield key


# --- labelling functions: 1 defect, 0 fine, 2 nothing to say ----------------------------------
#
# Each looks at another kind of evidence and can be wrong by itself; none repeats another's signal.
# empty:     visible content | placeholder phrase | size against the other answer
# refusal:   phrase | what else is said | words shared with the prompt | opening | persons and negations
# copy:      runs taken over | how much of the prompt comes back | new words | length against the prompt
# truncated: last sign | open structure | ends seen in all answers | last word | end of the last list item against the others
#            (only where the last sign leaves it open)
# language:  small words | letters | word endings | the other answer
FUNCTIONS = {"empty": 3, "refusal": 5, "copy": 4, "truncated": 5, "language": 4}
PERSONS = frozenset("i we my our me can cannot not t won unable ich wir mir mich kann nicht kein keine keinen je j nous me ne n pas peux yo me mi no puedo nosotros 我 我们 不 无 能 法".split())
LETTERS = {"de": "äöüß", "fr": "àâçèêëîïôœùûæ", "es": "ñ¿¡áíóú"}
ENDINGS = {
    "en": "ing tion ness ould ight ough ment ther ally ould ever".split(), "de": "ung lich isch keit heit chen eren iert sche ssen ngen".split(),
    "fr": "eur eux aux elle ette aient ement ique ais oir aire".split(), "es": "ción ando iendo idad mente aron ado ada ble dor ería".split(),
}
_ENDING = {e: lang for lang, ends in ENDINGS.items() for e in ends}
_ENDING_SIZES = sorted({len(e) for e in _ENDING}, reverse=True)
_SMALL: dict[str, tuple[str, ...]] = {}
for _lang, _words in _OWN.items():
    for _w in _words:
        _SMALL[_w] = (*_SMALL.get(_w, ()), _lang)


class Prompt:
    """What the functions ask of a prompt, worked out once for both answers."""

    __slots__ = ("text", "tokens", "known", "pairs", "tail", "want")

    def __init__(self, text: str):
        self.text, self.tokens = text, tokens(text)
        self.known, self.pairs = set(self.tokens), set(zip(self.tokens, self.tokens[1:]))
        last = tokens((SENTENCE.findall(text.strip()) or [text])[-1])
        self.tail = set(zip(last, last[1:]))
        self.want = expected_language(text)


def votes_empty(prompt: Prompt, answer: str | None, other: str | None) -> list[int]:
    if answer and SOME_WORDS.search(answer):
        return [FINE, FINE, FINE]
    inner = re.sub(r"<\|[^|>]*\|>(?:assistant|user|system)?|</?[A-Za-z_]+>|```\w*|^(?:assistant|answer|response)\s*:?\s*$", "", (answer or ""), flags=re.I | re.M)
    kept = visible(inner)
    has_word = any(c.isalnum() for c in kept)
    nothing = not kept or not has_word and not any(unicodedata.category(c) in ("So", "Sm", "Sc") for c in kept)
    bare = bool(PLACEHOLDER.fullmatch(kept.strip() and inner.strip() or "x")) and not (inner.strip() in ("Na", "NA") and len(prompt.text) < 40)
    size = len(kept) / max(1, len(other or "")) if other and len(other) > 20 else None
    return [DEFECT if nothing else FINE if len(kept) > 24 else ABSTAIN, int(bare) if has_word else ABSTAIN, ABSTAIN if size is None else DEFECT if size < 0.03 else FINE]


def _may_refuse(text: str) -> bool:
    low = text.lower()
    for part in REFUSAL_PARTS if not low.isascii() else _ASCII_PARTS:
        if part in low:
            return True
    return False


def refuses(sentence: str) -> bool:
    return _may_refuse(sentence) and REFUSES.search(sentence) is not None


def content_words(words: list[str]) -> list[str]:
    return [w for w in words if len(w) > 3 or "一" <= w <= "鿿"]


def vote_shared(prompt: Prompt, content: list[str]) -> int:
    if not content:
        return ABSTAIN
    shared = sum(map(prompt.known.__contains__, content)) / len(content)
    return DEFECT if shared < 0.12 else FINE if shared > 0.4 else ABSTAIN


def votes_refusal(prompt: Prompt, answer: str, words: list[str]) -> list[int]:
    bare = QUOTED.sub(' " ', FENCE.sub(" code" * 9 + " ", answer)) if quotes(answer) else answer
    said, rest = False, 0
    may = _may_refuse(bare)
    for i, m in enumerate(SENTENCE.finditer(bare)):
        s = m.group().strip()
        if may and i < 3 and refuses(s) and not REFUSES_NOT.search(s):
            said = True
        elif s and not COURTESY.match(s) and not (said and refuses(s)):
            rest += len(s) * (3 if IDEOGRAPH.search(s) else 1)
        if rest >= 60 and i >= 2:
            break
    person = sum(map(PERSONS.__contains__, words)) / len(words) if len(words) > 4 else None
    return [
        int(said), int(rest < 60), vote_shared(prompt, content_words(words)),
        int(COURTESY.match(answer.lstrip()) is not None), ABSTAIN if person is None else int(person >= 0.12),
    ]


def votes_copy(prompt: Prompt, answer: str, words: list[str]) -> list[int]:
    n, asked = len(words), len(prompt.tokens)
    ratio = int(0.4 * asked <= n <= 2 * asked)
    if n < 4 or not asked:
        return [FINE, FINE, ABSTAIN, ratio]
    new = n - sum(map(prompt.known.__contains__, words))
    fresh = int(new <= max(6, 0.2 * n))
    if new > 0.5 * n:  # then under half of the runs of two can be the prompt's
        return [FINE, FINE, fresh, ratio]
    runs = list(zip(words, words[1:]))
    own = set(runs)
    shared = sum(map(prompt.pairs.__contains__, runs)) / len(runs)
    back = max(len(own & prompt.pairs) / max(1, len(prompt.pairs)), len(own & prompt.tail) / max(1, len(prompt.tail)))
    return [int(shared >= 0.65), int(back >= 0.5), fresh, ratio]


def votes_truncated(answer: str, words: list[str]) -> tuple[list[int], str | None]:
    """Votes (the third is looked up later) and the key to look up: whether the end is one seen in all answers."""
    text = answer.rstrip()
    fences = len(re.findall(r"^\s*```", text, re.M)) if "```" in text else 0
    if fences % 2:
        return [ABSTAIN if text[-1:] in ")]}\"'`.;:" else DEFECT, DEFECT, ABSTAIN, ABSTAIN, ABSTAIN], None
    if fences and text.endswith("```"):
        return [FINE, FINE, ABSTAIN, ABSTAIN, ABSTAIN], None
    bare = FENCE.sub(" ", text) if fences else text
    end = text[-1:]
    stopped = end in ".!?。！？…"
    structure = ABSTAIN
    if "(" in bare or "`" in bare or "[" in bare or "{" in bare or not bare.isascii() and any(c in bare for c in "（「“"):
        depth = any(bare.count(o) > bare.count(c) for o, c in ("{}", "[]", "()", "（）", "「」", "“”"))
        structure = DEFECT if (depth and not stopped) or bare.count("`") % 2 else FINE
    sign = DEFECT if end in ",，、;；:：([{（「“=+/\\_" else FINE if stopped or end in ")]}）」”\"'`%" or unicodedata.category(end or "x")[0] == "S" or end in "️‍" else ABSTAIN
    if sign != ABSTAIN:
        return [sign, structure, ABSTAIN, ABSTAIN, ABSTAIN], None
    if len(words) < 4 or (len(words) < 12 and "\n" not in text and not re.search(r"[.!?。！？，,]", text)):
        return [FINE, structure, ABSTAIN, ABSTAIN, ABSTAIN], None  # a value or a title
    key, item = end_key(text), ABSTAIN
    last = bare.rsplit("\n", 1)[-1]
    listed = LIST_ITEM.match(last) is not None
    if listed:
        others = [x.strip()[-1:] in ".!?。！？" for x in bare.split("\n")[:-1] if LIST_ITEM.match(x)]
        if others:
            item = int(2 * sum(others) > len(others))
    word = int(words[-1] in _SMALL)
    return [ABSTAIN if listed else DEFECT, structure, ABSTAIN, word, item], key


class _Words(dict):
    """The kind of a word, a place in ``kinds``: (ideograph, languages whose small word it is, language of its ending)."""

    def __init__(self):
        super().__init__()
        self.kinds: list[tuple] = []
        self.places: dict[tuple, int] = {}

    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        small = _SMALL.get(w, ())
        end = None if small or len(w) < 5 else next((_ENDING[w[-k:]] for k in _ENDING_SIZES if w[-k:] in _ENDING), None)
        kind = ("一" <= w <= "鿿", small, end)
        if kind not in self.places:
            self.places[kind] = len(self.kinds)
            self.kinds.append(kind)
        self[w] = out = self.places[kind]
        return out


_WORDS = _Words()


def answer_language(answer: str, words: list[str]) -> tuple[Counter, Counter, Counter]:
    """Evidence for each language by small words, by letters and by word endings of the prose."""
    text = prose(answer)
    if text is not answer:
        words = tokens(text)
    small: Counter = Counter()
    ends: Counter = Counter()
    latin = han = 0
    for kind, n in Counter(map(_WORDS.__getitem__, words)).items():
        ideograph, of, end = _WORDS.kinds[kind]
        if ideograph:
            han += n
            continue
        latin += n
        for lang in of:
            small[lang] += n
        if end:
            ends[end] += n
    letters: Counter = Counter()
    if latin:
        low = text.lower()
        if not low.isascii():
            for lang, own in LETTERS.items():
                if n := sum(map(low.count, own)):
                    letters[lang] = n
        if not letters and latin > 40:
            letters["en"] = 1
    if han > 1.5 * latin:
        letters["zh"] = sum(letters.values()) + han
        small["zh"] = sum(small.values()) + han
        ends["zh"] = sum(ends.values()) + han
    return small, letters, ends


def main_language(seen: tuple[Counter, Counter, Counter] | None) -> str | None:
    return max(seen[0].items(), key=lambda x: x[1])[0] if seen and sum(seen[0].values()) >= 4 else None


def votes_by_scores(wants: tuple[str, ...], seen: tuple[Counter, Counter, Counter]) -> list[list[int]]:
    """For each language that could be wanted, the votes by small words, letters and endings."""
    columns = []
    for scores, least in zip(seen, (4, 1, 2)):
        if sum(scores.values()) < least:
            columns.append([ABSTAIN] * len(wants))
            continue
        most = max(scores.values())
        columns.append([FINE if n == most else DEFECT if n < 0.5 * most else ABSTAIN for n in map(scores.__getitem__, wants)])
    return list(map(list, zip(*columns)))


def vote_by_other(want: str, mine: str | None, theirs: str | None) -> int:
    return ABSTAIN if mine is None or theirs is None else FINE if mine == theirs else DEFECT if theirs == want else ABSTAIN


def votes_language(want: str | None, seen: tuple[Counter, Counter, Counter], other: tuple[Counter, Counter, Counter] | None) -> list[int]:
    if not want:
        return [ABSTAIN] * 4
    return [*votes_by_scores((want,), seen)[0], vote_by_other(want, main_language(seen), main_language(other))]


class Judged:
    """Votes on both answers of a prompt and the end of each to look up (``done``), and what they were drawn from."""

    __slots__ = ("prompt", "seen", "done")

    def __init__(self, prompt: str, answers: list[str | None]):
        self.prompt = asked = Prompt(prompt)
        empty = [votes_empty(asked, x, y) for x, y in (answers, answers[::-1])]
        blank = [_blank(x, e) for x, e in zip(answers, empty)]
        words = [[] if b else tokens(x) for x, b in zip(answers, blank)]
        self.seen = seen = [None if b else answer_language(x, w) for x, b, w in zip(answers, blank, words)]
        self.done: list[tuple[dict[str, list[int]], str | None]] = []
        for i, answer in enumerate(answers):
            if blank[i]:
                self.done.append(({"empty": empty[i]} | {d: [ABSTAIN] * FUNCTIONS[d] for d in DEFECTS[1:]}, None))
                continue
            truncated, key = votes_truncated(answer, words[i])
            self.done.append((
                {"empty": empty[i], "refusal": votes_refusal(asked, answer, words[i]), "copy": votes_copy(asked, answer, words[i]),
                 "truncated": truncated, "language": votes_language(asked.want, seen[i], seen[1 - i])}, key,
            ))


def _blank(answer: str | None, empty: list[int]) -> bool:
    return answer is None or DEFECT in empty[:2]


def vote_pair(prompt: str, answers: list[str | None]) -> list[tuple[dict[str, list[int]], str | None]]:
    """Votes on both answers of a prompt, and the end of each to look up."""
    return Judged(prompt, answers).done


# --- label model -----------------------------------------------------------------------------
def fit_label_model(patterns: dict[tuple[int, ...], int], rounds: int = 60, prior: float = 4.0) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by expectation maximization.

    Two classes; every function has its own rates of votes in each, independent given
    the class; where it abstains it says nothing. Starts from the majority of votes;
    Dirichlet counts (``prior``) keep functions better than chance, so the classes
    can't change places.
    """
    if not patterns:
        return {}
    k = len(next(iter(patterns)))
    post = {}
    for p in patterns:
        yes, no = p.count(DEFECT), p.count(FINE)
        post[p] = 0.95 if yes > no else 0.5 if yes == no else 0.02
    total = sum(patterns.values())
    for _ in range(rounds):
        mass = sum(n * post[p] for p, n in patterns.items())
        pi = (mass + prior) / (total + 20 * prior)
        rate = []
        for j in range(k):
            yes, no = [0.5 * prior, 2 * prior], [2 * prior, 0.5 * prior]
            for p, n in patterns.items():
                if p[j] != ABSTAIN:
                    yes[p[j]] += n * post[p]
                    no[p[j]] += n * (1 - post[p])
            rate.append(([x / sum(yes) for x in yes], [x / sum(no) for x in no]))
        new = {}
        for p in patterns:
            odds = math.log(pi / (1 - pi)) + sum(math.log(rate[j][0][v] / rate[j][1][v]) for j, v in enumerate(p) if v != ABSTAIN)
            new[p] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        done = max(abs(new[p] - post[p]) for p in patterns) < 1e-6
        post = new
        if done:
            break
    return post


def validate_cutoffs(scored: list[tuple[str, float, bool, float]], grid: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> dict[str, float]:
    """The cutoff of each defect with the best F1 on labelled (defect, posterior, truth, weight) rows; ties go to 0.5."""
    out = {}
    for d in DEFECTS:
        rows = [(p, t, w) for name, p, t, w in scored if name == d]

        def f1(c: float) -> float:
            tp = sum(w for p, t, w in rows if t and p >= c)
            wrong = sum(w for p, t, w in rows if t != (p >= c))
            return 2 * tp / (2 * tp + wrong) if tp else 0.0

        out[d] = max(grid, key=lambda c: (round(f1(c), 6), -abs(c - 0.5))) if any(t for _, t, _ in rows) else 0.5
    return out


# --- fixed values: answers that decline, for the rows that the cutoffs are validated on
DECLINED = {
    "en": ("I am not able to assist with this request.", "Sorry, I must decline to answer that."), "de": ("Bei dieser Anfrage kann ich nicht helfen.", "Leider muss ich das ablehnen."),
    "fr": ("Je ne peux pas traiter cette demande.", "Désolé, je dois refuser de répondre."), "es": ("No puedo ayudar con esta petición.", "Lo siento, debo rechazar la pregunta."), "zh": ("抱歉，我无法回答这个问题。", "我不能提供帮助。"),
}


EMPTIED = ("", " \n", "...", None)
PLANT_LENGTH = 80


@cache
def _declined(text: str) -> tuple[list[str], list[int]]:
    """Content words of an answer that declines, and the votes on it under an empty prompt."""
    words = tokens(text)
    return content_words(words), votes_refusal(Prompt(""), text, words)


def _end_words(text: str) -> list[str]:
    """The last words, as many as ``votes_truncated`` may ask for; the first of them can lack its beginning."""
    last = tokens(text[-160:])
    return last if len(last) > 12 else tokens(text)


def planted(id_: object, judged: Judged, chosen: str, other: str | None) -> tuple[dict[str, str], str | None]:
    """Patterns of votes on the chosen answer with each defect made in turn, and the end of the cut one to look up.

    Emptied, replaced by an answer that declines or by the prompt, cut within a
    sentence; the id tells which of the ways and where. Where no cut is left
    within a sentence or the prompt has no language, that defect has no pattern.
    For the language see ``language_parts``: the exchange is made of counts.
    """
    prompt, at = judged.prompt, zlib.crc32(repr(id_).encode())
    out = {"empty": _pattern(votes_empty(prompt, EMPTIED[at % 4], other))}
    content, votes = _declined(DECLINED[prompt.want or "en"][at % 2])
    out["refusal"] = _pattern([*votes[:2], vote_shared(prompt, content), *votes[3:]])
    made = (prompt.text, prompt.text + "\n", f"> {prompt.text}")[at % 3]
    blank = _blank(made, votes_empty(prompt, made, other))
    out["copy"] = _pattern([ABSTAIN] * FUNCTIONS["copy"] if blank else votes_copy(prompt, made, prompt.tokens))
    key, first, last = None, int(0.3 * len(chosen)), int(0.95 * len(chosen))
    made = chosen[: first + at % (last - first + 1)].rstrip()
    if made[-1:] not in tuple(".!?。！？`"):
        blank = _blank(made, votes_empty(prompt, made, other))
        votes, key = ([ABSTAIN] * FUNCTIONS["truncated"], None) if blank else votes_truncated(made, _end_words(made))
        out["truncated"] = _pattern(votes)
    if prompt.want:
        out["language"] = language_parts(prompt.want, *judged.seen)
    return out, key


def language_parts(want: str, seen: tuple[Counter, Counter, Counter] | None, other: tuple[Counter, Counter, Counter] | None) -> str:
    """What a record brings to the exchange of answers between languages.

    ``want<theirs``: the language of its prompt and that of its other answer.
    ``lang>votes mine``: how its chosen answer would be voted under a prompt of each other language, and its own.
    """
    mine = main_language(seen) or "-"
    parts = [f"{want}<{main_language(other) or '-'}"]
    others = tuple(lang for lang in ASKED if lang != want)
    votes = votes_by_scores(others, seen) if seen else [[ABSTAIN] * 3] * len(others)
    return " ".join(parts + [f"{lang}>{_pattern(v)}{mine}" for lang, v in zip(others, votes)])


def exchanged(parts: dict[str, int]) -> dict[tuple[int, ...], int]:
    """Patterns of all chosen answers put to all prompts of another language, from the counts of their parts."""
    out: Counter = Counter()
    for asked, n in parts.items():
        if asked[2] == "<":
            for given, m in parts.items():
                if given[:3] == asked[:2] + ">":
                    mine, theirs = (None if x == "-" else x for x in (given[6:], asked[3:]))
                    out[*map(int, given[3:6]), vote_by_other(asked[:2], mine, theirs)] += n * m
    return dict(out)


def _pattern(votes: list[int]) -> str:
    return "".join(map(str, votes))


def _with_known(votes: DataFrame, known: DataFrame) -> DataFrame:
    """``votes`` with the look-up vote put into ``truncated``.

    Rows without a key take no part in the join. Keys that hold over a
    thousandth of the rows (a thousand at most) are joined by broadcast.
    """
    bare = votes.filter("key is null").withColumn("known", F.lit(None).cast("boolean"))
    keyed = votes.filter("key is not null")
    count = keyed.groupBy("key").count()
    hot = written(count.filter(F.col("count") > F.lit(max(10_000, keyed.count() // 1000))).join(known, "key", "left").select("key", F.coalesce("known", F.lit(False)).alias("known")), "pairs-hot")
    often = keyed.join(F.broadcast(hot), "key")
    rest = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").join(known, "key", "left")
    both = bare.unionByName(often).unionByName(rest.withColumn("known", F.coalesce("known", F.lit(False))))
    seen = F.when(F.col("known").isNull(), F.lit(str(ABSTAIN))).when(F.col("known"), F.lit(str(FINE))).otherwise(F.lit(str(DEFECT)))
    return both.withColumn("truncated", F.concat(F.substring("truncated", 1, 2), seen, F.substring("truncated", 4, 9))).drop("known", "key")


def defective_pairs(df: DataFrame, id_col: str = "record_id", cutoffs: dict[str, float] | None = None) -> DataFrame:
    """id, ``side``, ``defect``, ``posterior`` of every label at or above its cutoff (several per answer if so).

    The prompt is ``legacy_input`` where ``prompt`` is null; both null is an empty
    prompt. A null answer is empty. Rows delivered twice count once; rows without
    id are left out. An empty table has no labels.

    Texts are read in one pass, both answers of a prompt together: it gives the
    votes and counts of the ends of sentences and items, which tell whether an
    answer's end was seen elsewhere. The rest works on votes: at most 3**5
    patterns a defect reach the driver. Cutoffs not given are validated on all
    records whose chosen answer has ``PLANT_LENGTH`` characters: the same pass
    votes on it as it is and with each defect made (``planted``), and the counts
    of those patterns, under a thousand more, go to ``validate_cutoffs``.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(prompt_of(df), F.lit("")).alias("prompt"), "chosen", "rejected")
    id_type = rows.schema["id"].dataType.simpleString()
    chosen_cutoffs = dict(cutoffs or {})
    validates = bool(set(DEFECTS) - chosen_cutoffs.keys())
    names = ["id", "side", "plants", "key", *DEFECTS, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: list[int] = []
            plants: list[bool] = []
            cols: list[list] = [[] for _ in range(2 + len(DEFECTS))]
            ends: Counter = Counter()

            def add(i: int, side: str, plant: bool, key: str | None, patterns: dict[str, str]) -> None:
                of.append(i)
                plants.append(plant)
                for col, v in zip(cols, (side, key, *map(patterns.get, DEFECTS))):
                    col.append(v)

            for i, (id_, prompt, *answers) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                judged = Judged(prompt, answers)
                plant = validates and answers[0] is not None and len(answers[0]) >= PLANT_LENGTH
                for side, answer, (votes, key) in zip(("chosen", "rejected"), answers, judged.done):
                    add(i, side, plant and side == "chosen", key, {d: _pattern(v) for d, v in votes.items()})
                    if answer:
                        ends.update(set(inner_ends(answer)))
                if plant:
                    made, key = planted(id_, judged, *answers)
                    add(i, "planted", False, key, made)
            side, *rest = (pa.array(c, pa.string()) for c in cols)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), side, pa.array(plants, pa.bool_()), *rest, pa.nulls(len(of), pa.int64())], names=names)
            none = pa.nulls(len(ends), pa.string())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ends), batch.column(0).type), none, pa.nulls(len(ends), pa.bool_()), pa.array(list(ends), pa.string()), *[none] * len(DEFECTS), pa.array(list(ends.values()), pa.int64())], names=names)

    raw = written(rows.mapInArrow(run, f"id {id_type}, side string, plants boolean, key string, " + ", ".join(f"`{d}` string" for d in DEFECTS) + ", n bigint"), "pairs-raw")
    known = raw.filter("n is not null").groupBy("key").agg(F.sum("n").alias("n")).filter("n >= 3").select("key", F.lit(True).alias("known"))
    votes = written(_with_known(raw.filter("n is null").drop("n"), known).dropDuplicates(["id", "side"]), "pairs-votes")
    each = votes.select("id", "side", "plants", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS])).alias("v")).select("id", "side", "plants", "v.*")
    found, sound, made = ({d: Counter() for d in DEFECTS} for _ in range(3))
    parts: dict[str, int] = {}
    counted = each.filter("pattern is not null").select((F.col("side") == "planted").alias("made"), "plants", "defect", F.explode(F.split("pattern", " ")).alias("pattern"))
    for is_made, plants, d, pattern, n in sorted(counted.groupBy("made", "plants", "defect", "pattern").count().collect()):
        if is_made and d == "language":
            parts[pattern] = n
            continue
        for counts in (made,) if is_made else (found, sound) if plants else (found,):
            counts[d][tuple(map(int, pattern))] += n
    posts = {d: fit_label_model(found[d]) for d in DEFECTS}
    if validates and any(found.values()):
        made["language"] = exchanged(parts)
        chosen_cutoffs = _validated(found, posts, sound, made) | chosen_cutoffs
    kept = [(_pattern(p), d, x) for d in DEFECTS for p, x in posts[d].items() if x >= chosen_cutoffs.get(d, 0.5)]
    small = spark.createDataFrame(kept, "pattern string, defect string, posterior double")
    return each.filter("side <> 'planted'").join(F.broadcast(small), ["defect", "pattern"]).select(F.col("id").alias(id_col), "side", "defect", "posterior")


def _validated(found: dict, posts: dict, sound: dict, made: dict) -> dict[str, float]:
    """Cutoffs from the counts of votes on answers as they are and with a defect made, which weigh what the model finds of it."""
    scored = []
    for d in DEFECTS:
        scored += [(d, posts[d].get(p, 0.0), False, float(n)) for p, n in sound[d].items()]
        share = sum(n * posts[d][p] for p, n in found[d].items()) / max(1, sum(found[d].values()))
        weight = share * sum(sound[d].values()) / max(1, sum(made[d].values()))
        scored += [(d, posts[d].get(p, 0.0), True, n * weight) for p, n in made[d].items()]
    return validate_cutoffs(scored)


def single_defect(labels: DataFrame, id_col: str = "record_id") -> DataFrame:
    """The one defect of each answer: an empty answer is only empty, a refusal in another language a refusal, and so on down ``DEFECTS``."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return labels.groupBy(id_col, "side").agg(F.min_by("defect", rank).alias("defect")).select(id_col, "side", "defect")
