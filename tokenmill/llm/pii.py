"""Personal information in free text by a semi-Markov conditional random field (problem 9).

Candidate segments come from shape alone: digit groups in formats of numbers, spans around an at sign, street words
beside a number, every run of capitalised words, and ideographs that can begin a name. No list of given names is
looked up. What a segment is follows from features of the whole span (form, word classes, endings), of the words
beside it and of its place in the line; their weights are fitted on the sentences of ``pii_training``. Word classes
come from public vocabularies: whether a word has a token of its own in lower case, only capitalised, or not at all.
"""

from __future__ import annotations

import base64
import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.common import TOKENIZER_DIR

KINDS = ("email", "phone", "identity", "address", "name")
WEIGHTS = Path(__file__).with_name("pii_weights.json")

# --- fixed values ------------------------------------------------------------------------------------
#: The hundred most frequent family names of China, then the first twelve lines of the Hundred Family Surnames.
FAMILY_ZH_COMMON = "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦阎薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严尹钱施牛洪龚"
FAMILY_ZH_CLASSIC = "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄"
#: Characters of common given names of women, then of men.
GIVEN_ZH_F = "秀娟英华慧巧美娜静淑惠珠翠雅芝玉萍红娥玲芬芳燕彩春菊兰凤洁梅琳素云莲真环雪荣爱妹霞香月莺媛艳瑞凡佳嘉琼勤珍贞莉桂娣叶璧璐娅琦晶妍茜秋珊莎锦黛青倩婷姣婉娴瑾颖露瑶怡婵雁蓓纨仪荷丹蓉"
GIVEN_ZH_M = "伟刚勇毅俊峰强军平保东文辉力明永健世广志义兴良海山仁波宁贵福生龙元全国胜学祥才发武新利清飞彬富顺信子杰涛昌成康星光天达安岩中茂进林有坚和彪博诚先敬震振壮会思群豪心邦承乐绍功松善"
GIVEN_ZH = frozenset(GIVEN_ZH_F + GIVEN_ZH_M)
TITLES = "dr mr mrs ms miss prof sir herr frau m mme mlle monsieur madame señor señora sr sra don doña doktor professor".split()
PARTICLES = "van von der den de del della di da la le du dos das bin ibn al el y"
STREETS = {
    "en": "street st road rd avenue ave lane ln court ct crescent cres drive dr way place pl terrace close square sq boulevard blvd parkway pkwy highway hwy row walk mews gardens grove hill circle trail alley quay wharf",
    "de": "straße strasse str. allee gasse weg platz ring damm ufer", "fr": "rue boulevard bd avenue av. chemin allée place quai impasse cours route passage square",
    "es": "calle c/ avenida avda. av. plaza pza. paseo camino ronda travesía carretera", "zh": "大道 路 街 巷 弄 道",
}


# --- word classes --------------------------------------------------------------------------------------
class Lexicon:
    """Classes of words by the public byte-level vocabularies of a folder.

    ``common``: with a token in lower case, more frequent than the capitalised one;
    ``either``: the capitalised one is more frequent; ``proper``: only capitalised; ``rare``: no token.
    """

    def __init__(self, folder: str):
        tokens: set[str] = set()
        kinds: dict[str, str] = {}
        for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
            ranks: dict[str, int] = {}
            with open(f"{folder}/{name}", "rb") as f:
                for line in f:
                    token, rank = line.split()
                    try:
                        ranks[base64.b64decode(token).decode()] = int(rank)
                    except UnicodeDecodeError:
                        continue
            tokens.update(ranks)
            words = {t[1:].lower() for t in ranks if t[:1] == " " and len(t) > 2 and t[1:].isalpha() and (t.islower() or t.istitle())}
            for w in words - kinds.keys():  # a smaller rank is a more frequent token
                low, title = ranks.get(" " + w), ranks.get(" " + w.title())
                kinds[w] = "proper" if low is None else "common" if title is None or low < title else "either"
        self.kinds = kinds
        self.han = frozenset(t for t in tokens if t and all("一" <= c <= "鿿" for c in t))
        self.lower_words, self.title_words = sorted(w for w, k in kinds.items() if k != "proper" and len(w) > 3), sorted(w.title() for w, k in kinds.items() if k == "proper" and len(w) > 3)
        self.all_han = "".join(chr(c) for c in range(0x4E00, 0x9FA6) if _in_gb2312(chr(c)))
        self.rare = frozenset(chr(c) for c in range(0x4E00, 0xA000)) - self.han - frozenset(self.all_han)
        self.zh_first = re.compile(f"[{''.join(sorted(_COMMON_ZH | self.rare))}](?=[一-鿿])|(?<=[{re.escape(''.join(sorted(ZH_OPENS)))}])[一-鿿](?=[一-鿿])")
        self.rare_han = "".join(sorted(c for c in self.rare if _in_gb2312(c, 2)))

    @lru_cache(maxsize=200_000)  # noqa: B019 - one lexicon per worker
    def features(self, word: str) -> tuple[str, str, tuple[str, ...]]:
        """Class, shape and endings of a word."""
        low = word.lower()
        parts = low.replace("’", "'").split("-")
        of = {self.kinds.get(p, "rare") for p in parts}
        kind = next(k for k in ("rare", "proper", "either", "common") if k in of)
        shape = "initial" if len(word.rstrip(".")) == 1 else "upper" if word.isupper() else "title" if word[1:].islower() else "hyphen" if "-" in word and all(p[1:].islower() for p in word.split("-")) else "mixed"
        if any(c.isdigit() or c == "_" for c in word):
            shape = "digit"
        ends = (f"~{low[-3:]}", f"~{low[-2:]}", f"^{low[:2]}", f"#{min(len(low), 12)}")
        return kind, shape, ends


def _in_gb2312(c: str, level: int = 1) -> bool:
    """Whether a character is of the first level of the standard (in daily use) or the second."""
    try:
        return (0xB0 <= c.encode("gb2312")[0] <= 0xD7) == (level == 1)
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=4)
def lexicon(folder: str = TOKENIZER_DIR) -> Lexicon:
    return Lexicon(folder)


# --- candidate segments ----------------------------------------------------------------------
_AT = r"(?:\s?[@＠]\s?|\s?[\[(]\s?at\s?[\])]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9À-ÿ._%+\-])[A-Za-z0-9À-ÿ][A-Za-z0-9À-ÿ._%+\-]*{_AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9@])", re.I)
AT_WORD = re.compile(r"[Aa][Tt]\s?[\])]?\s{0,2}[A-Za-z0-9\-]+(?:\.[A-Za-z0-9]|\s?[\[(]?\s?[Dd][Oo][Tt])")  # what EMAIL needs behind a written "at"
DIGITS = re.compile(r"\d(?:[ \-–./()]{0,3}\d){5,}")
CAP = r"[A-ZÀ-ÖØ-Þ]"
WORD = rf"{CAP}(?:[\w'’]*\w)?(?:-{CAP}[\w'’]*)*"
_TOWN = rf"(?:, (?:\d{{4,5}} )?{CAP}[\w’'\-]+(?: {CAP}[\w’'\-]+)?(?!\w))"
_UNIT = r"(?:Apt|Apartment|Unit|Flat|Suite)\.? ?\d+[A-Za-z]?"
_REST = rf"(?:, {_UNIT})?{_TOWN}?"


def _either(lang: str, title: bool = False) -> str:
    words = sorted(STREETS[lang].split(), key=len, reverse=True)
    words = [w.title() for w in words] + [w.upper() for w in words] if title else words
    return "|".join(re.escape(w) for w in words)


ADDRESS_EN = re.compile(rf"\d{{1,5}}[A-Za-z]?,? (?:{CAP}[\w'’\-]*\.? ){{1,3}}(?:{_either('en', True)})\b\.?{_REST}")
ADDRESS_EN_BARE = re.compile(rf"\d{{1,5}}[A-Za-z]? {CAP}[\w'’\-]+{_TOWN}")
UNIT = re.compile(rf"{_UNIT}, $", re.I)
ADDRESS_DE = re.compile(rf"(?<!\w)(?:{CAP}[\wß]*[ \-])?{CAP}[\wß]*(?:[ \-]?(?i:{_either('de')}))\s\d{{1,4}}(?:\s?[A-Za-z])?\b{_REST}")
DE_WORD = re.compile(_either("de"), re.I)  # of one word only
DE_GATE = re.compile(rf"(?:{_either('de')})\s\d")
DE_WORDS, ES_WORDS = STREETS["de"].split(), STREETS["es"].split()
ES_GATE = re.compile(rf"(?<!\w)(?:{_either('es')})[^\d\n]{{1,200}}\d")
FR_WORDS = [f" {w} " for w in STREETS["fr"].split()]
ADDRESS_FR = re.compile(rf"(?<![\w\-])\d{{1,4}}(?:\s?(?:bis|ter))?,? (?:{_either('fr')}) (?:de la |de l['’]|du |des |de |d['’])?{CAP}[\w'’\-]*(?:[ \-]{CAP}[\w'’\-]*)*{_REST}", re.I)
ADDRESS_ES = re.compile(rf"(?<!\w)(?:{_either('es')}) ?(?:de las |de los |de la |del |de )?{CAP}[\w'’\-]*(?: (?:de |del |de la |de los )?{CAP}[\w'’\-]*)*,? (?:n\.?[º°o]\.? ?|núm\. )?\d{{1,4}}\b{_REST}", re.I)
ADDRESS_ZH = re.compile(rf"(?:{_either('zh')})[\d０-９]+号(?:[\d０-９]+[栋幢座])?(?:[\d０-９]+室)?")
CITY_ZH = re.compile(r"[一-鿿]{2}市$|[一-鿿]{3}市$")
#: Where a run can begin: a capital with another, an initial or a particle behind its word.
CAPITAL = re.compile(rf"{CAP}(?=[\w'’\-]*\.?,? ?(?:{CAP}|{PARTICLES} ))")
NAME_FORMS = (
    ("two", re.compile(rf"({WORD}) ({WORD})(?![\w@])")),
    ("middle", re.compile(rf"({WORD}) (?:{CAP}\. ){{1,2}}({WORD})(?![\w@])")),
    ("initial", re.compile(rf"({CAP})\.(?:[ -]?{CAP}\.)? ?({WORD})(?![\w@])")),
    ("comma", re.compile(rf"({WORD}), ({WORD})(?![\w@])")),
    ("comma initial", re.compile(rf"({WORD}), ({CAP})\.(?![\w@])")),
    ("three", re.compile(rf"({WORD}) {WORD} ({WORD})(?![\w@])")),
    ("particle", re.compile(rf"({WORD}|{CAP}\.) {PARTICLES} ({WORD})(?![\w@])")),
)
WIDE = str.maketrans("０１２３４５６７８９＋－（）．　", "0123456789+-(). ")
LATIN = re.compile(r"[^\W\d_一-鿿]+")
LAST_WORDS = re.compile(r"[^\W\d_一-鿿]+(?=[\W\d_]|$)")
LAST_WORD, NEXT_WORD = re.compile(r"([^\W\d_一-鿿]+)[ .:]{0,2}$"), re.compile(r" ?([^\W\d_一-鿿]+)")


def _han(c: str) -> bool:
    return "一" <= c <= "鿿"


def _sign(c: str) -> str:
    """The kind of a character beside a segment."""
    return "end" if not c else "han" if _han(c) else "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "_" if c == " " else "/" if c == "\n" else c


def _ahead(text: str, start: int, kind: str) -> list[str]:
    """Features of what stands before a segment.

    Numbers and addresses look at the words of the line; names at the word
    beside them only, so that what a sentence is about tells them nothing.
    """
    before = text[max(0, start - 60) : start]
    line = before.rsplit("\n", 1)[-1]
    stem = line.rstrip(" \"'«“|>*`")
    end = stem[-1:]
    out = [f"{kind}:pre{_sign(before[-1:])}"]
    if end in (":", "：", "="):
        out.append(f"{kind}:key")
    if not stem or stem in ("-", "#", "user:"):
        out.append(f"{kind}:first")
    elif end in (";", "|", ",", "，", "、"):
        out.append(f"{kind}:field")
    bare = line.rstrip(" .:")
    if kind == "name":
        word = bare.rsplit(" ", 1)[-1].lstrip("(\"'«“>*`") if len(line) - len(bare) < 3 else ""
        if word.isalpha() and not _han(word[-1]):
            out += (f"name:-1={word.lower()}", f"name:-1{'upper' if word[0].isupper() else 'lower'}")
        else:
            out.append("name:-1none")
    else:
        words = LATIN.findall(line.lower())[-6:]
        out += {f"{kind}:bag={w}" for w in words}
        if words:
            out.append(f"{kind}:-1={words[-1]}")
        if len(words) > 1:
            out.append(f"{kind}:-2={words[-2]}")
    near = stem.rstrip(":：（( ")
    if near and _han(near[-1]):
        out += (f"{kind}:h1={near[-1]}", f"{kind}:h2={near[-2:]}")
        if kind != "name":
            out += {f"{kind}:hb={near[i : i + 2]}" for i in range(max(0, len(near) - 8), len(near) - 1)}
    return out


def _behind(text: str, end: int, kind: str) -> list[str]:
    """Features of what stands after a segment."""
    after = text[end : end + 30]
    rest = after.split("\n", 1)[0]
    out = [f"{kind}:post{_sign(after[:1])}"]
    if not rest.strip(" .!?,;。，"):
        out.append(f"{kind}:last")
    if after and _han(after[0]):
        out += (f"{kind}:n1={after[0]}", f"{kind}:n2={after[:2]}")
    elif kind == "name":
        more = NEXT_WORD.match(rest)
        out += (f"name:+1={more.group(1).lower()}", f"name:+1{'upper' if more.group(1)[0].isupper() else 'lower'}") if more else ("name:+1none",)
    else:
        more = LATIN.findall(rest.lower())[:3]
        out += {f"{kind}:then={w}" for w in more}
        if more:
            out.append(f"{kind}:+1={more[0]}")
    return out


def candidates(text: str, lex: Lexicon | None = None) -> list[tuple[int, int, str, list[str]]]:
    """Segments that could be a mention: start, end, kind, features. Overlaps are left to the model."""
    lex = lex or lexicon()
    out: list[tuple[int, int, str, list[str]]] = []

    def add(start: int, end: int, kind: str, *features: str) -> None:
        out.append((start, end, kind, [f"{kind}:bias", *[f"{kind}:{f}" for f in features], *_ahead(text, start, kind), *_behind(text, end, kind)]))

    if "@" in text or "＠" in text or AT_WORD.search(text):
        for m in EMAIL.finditer(text):
            s = m.group()
            bare = re.search(r"\sat\s", s, re.I) is not None
            hidden = re.search(r"[\[(\s]dot[\])\s]", s, re.I) is not None
            domain = re.split(r"@|＠|\bat\b", s, flags=re.I)[-1]
            add(m.start(), m.end(), "email", *(["number in domain"] if re.search(r"\d", domain) else []), "bare at" if bare else "sign", *(["bare at, plain dot"] if bare and not hidden else []))
    for m in DIGITS.finditer(text):
        _numbers(text, m.start(), m.end(), add)
    _addresses(text, add)
    _names(text, lex, out)
    _names_zh(text, lex, out)
    return out


PHONE_SHAPES = (
    ("+", re.compile(r"\(?\+\d{1,3}\)?[\d \-./()]{6,}")),
    ("bracket", re.compile(r"(?:1 ?)?\(\d{2,5}\)[ \-]?\d[\d \-]{4,}")),
    ("3-3-4", re.compile(r"(?:1[ \-.])?[2-9]\d{2}([ \-.])\d{3}\1\d{4}")),
    ("ten digits", re.compile(r"[2-9]\d{2}[2-9]\d{6}")),
    ("00", re.compile(r"00[1-9]\d{0,2}([ \-./])?\d[\d \-./]{4,}")),
    ("0", re.compile(r"0[1-9]\d{0,4}([ \-./])?\d[\d \-./]{4,}")),
    ("900", re.compile(r"[6-9]\d{2} \d{2} \d{2} \d{2}|\d{2} \d{3} \d{2} \d{2}|[6-9]\d{2} \d{3} \d{3}")),
    ("nine", re.compile(r"[6-9]\d{8}")),
    ("zh mobile", re.compile(r"1[3-9]\d[ \-]?\d{4}[ \-]?\d{4}")),
    ("zh land", re.compile(r"0\d{2,3}[ \-]?\d{7,8}")),
)
ID_SHAPES = (
    ("3-2-4", re.compile(r"\d{3}([ \-–])\d{2}\1\d{4}")),
    ("nine digits", re.compile(r"\d{9}")),
    ("two letters, six, letter", re.compile(r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]")),
    ("two letters, more", re.compile(r"[A-Za-z]{2} ?\d{6,7}")),
    ("letter, more", re.compile(r"[A-Za-z]\d{7,8}")),
    ("three letters, six", re.compile(r"[A-Za-z]{3}\d{6}")),
    ("eleven", re.compile(r"\d{11}|\d{2} \d{3} \d{3} \d{3}")),
    ("fifteen", re.compile(r"\d ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3}(?: ?\d{2})?")),
    ("digits, letter", re.compile(r"\d{8}[ \-]?[A-Za-z]")),
    ("ten, letter", re.compile(r"\d{10}[A-Za-z]")),
    ("letter, digits, letter", re.compile(r"[A-Za-z]\d{7}[A-Za-z]")),
    ("two, letters, five", re.compile(r"\d{2}[A-Za-z]{2}\d{5}")),
    ("eighteen", re.compile(r"\d{17}[\dXx]")),
)


PAIR = re.compile(r"(?<![A-Za-z0-9À-ÿ])(?:\d{2})?[A-Za-z]{1,3}[ \-]?$")
TAIL = re.compile(r"[ \-–]?[A-Za-z](?![A-Za-z0-9])")


def _numbers(text: str, start: int, end: int, add) -> None:
    lead = PAIR.search(text[max(0, start - 7) : start])
    before = text[start - 1 : start]
    if not lead and before and (before in "@_" or (before.isascii() and before.isalnum()) or (before == "." and text[start - 2 : start - 1].isdigit())):
        return
    begins = [start]
    if lead:
        begins.append(start - len(lead.group()))
    tail = TAIL.match(text, end)
    ends = [end, tail.end()] if tail else [end]
    for lo in begins:
        for hi in ends:
            s = text[lo:hi].translate(WIDE)
            for name, shape in ID_SHAPES:
                if shape.fullmatch(s):
                    add(lo, hi, "identity", name, *(["upper"] if s.upper() == s else []))
                    break
    lo = start
    while lo and text[lo - 1] in "+(＋（" and start - lo < 2:
        lo -= 1
    s = text[lo:end].translate(WIDE)
    if s.startswith("(") and ")" not in s:
        lo, s = start, text[start:end].translate(WIDE)
    if 7 <= sum(c.isdigit() for c in s) <= 15:
        for name, shape in PHONE_SHAPES:
            if shape.fullmatch(s):
                add(lo, end, "phone", name, f"{sum(c.isdigit() for c in s)} digits", "parted" if re.search(r"\d[ \-./()]+\d", s) else "whole")
                break


def _addresses(text: str, add) -> None:
    for lang, shape in (("en", ADDRESS_EN), ("en bare", ADDRESS_EN_BARE)):
        for m in shape.finditer(text):
            at = m.start()
            if at and (text[at - 1].isalnum() and text[at - 1] < "一" or text[at - 1] in "-@."):
                continue
            unit = UNIT.search(text[max(0, at - 20) : at])
            add(at - len(unit.group()) if unit else at, m.end(), "address", lang, *(["unit"] if unit else []))
    low = text.lower()
    if any(w in low for w in DE_WORDS) and DE_GATE.search(low):
        for m in ADDRESS_DE.finditer(text):
            cut = m.group().find(" ")
            words = m.group().split(" ")
            add(m.start(), m.end(), "address", "de", f"{len(words)} words", f"lead={words[0].lower()}", f"de {'joined' if DE_WORD.search(words[0]) else 'apart'}")
            if len(words) > 3 or (len(words) == 3 and len(words[1]) > 6 and DE_WORD.search(words[1])):
                add(m.start() + cut + 1, m.end(), "address", "de", "short", f"behind={words[0].lower()}")
    if any(w in low for w in FR_WORDS):
        for m in ADDRESS_FR.finditer(text):
            add(m.start(), m.end(), "address", "fr")
    if any(w in low for w in ES_WORDS) and ES_GATE.search(low):
        for m in ADDRESS_ES.finditer(text):
            add(m.start(), m.end(), "address", "es")
    if "号" in text:
        for m in ADDRESS_ZH.finditer(text):
            at = m.start()
            for k in range(1, 5):
                street = text[at - k : at] if at >= k else ""
                if not street or not all(map(_han, street)):
                    break
                rest = text[max(0, at - k - 4) : at - k]
                city = CITY_ZH.search(rest)
                if "市" in street:
                    continue
                add(at - k, m.end(), "address", "zh", f"zh street {k}", *(["zh city before"] if city else []))
                if city:
                    for c in (2, 3):
                        if len(rest) > c and rest[-1] == "市" and all(map(_han, rest[-1 - c : -1])):
                            add(at - k - c - 1, m.end(), "address", "zh", "zh city", f"zh city {c}", f"zh street {k}")


def _names(text: str, lex: Lexicon, out: list) -> None:
    """Every run of two or three capitalised words, with initials, a comma or particles between them."""
    for m in CAPITAL.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if before and (before in "@_+-'’" or (before.isalnum() and not _han(before)) or (before == "." and text[m.start() - 2 : m.start() - 1].isalnum())):
            continue
        for form, shape in NAME_FORMS:
            n = shape.match(text, m.start())
            if not n:
                continue
            a, b = n.group(1).rstrip("."), n.group(2)
            ka, sa, ea = lex.features(a)
            kb, sb, eb = lex.features(b)
            if "digit" in (sa, sb) or (sb == "initial" and form != "comma initial"):
                continue
            before = LAST_WORDS.findall(text[max(0, n.start() - 24) : n.start()].rsplit("\n", 1)[-1])[-1:]
            after = re.match(rf" ({WORD})", text[n.end() : n.end() + 30])
            features = [form, f"{ka}+{kb}", f"{form}:{ka}+{kb}", f"{sa}+{sb}", f"1{ka}", f"2{kb}", *[f"1{x}" for x in ea], *[f"2{x}" for x in eb], f"1={a.lower()}" if ka == "common" else "1other", f"2={b.lower()}" if kb == "common" else "2other"]
            if before and before[0].lower() in TITLES:
                features.append("title")
            if before and before[0][0].isupper() and before[0].lower() not in TITLES and text[n.start() - 1 : n.start()] == " ":
                features += ["capital before", f"capital before {lex.features(before[0])[0]}"]
            if after:
                features += ["capital after", f"capital after {lex.features(after.group(1))[0]}"]
            if a.lower() in TITLES:
                features.append("begins with title")
            if b.lower() in STREET_WORDS:
                features.append("street word")
            if text[n.start() - 2 : n.start() - 1].isdigit():
                features.append("number before")
            beside = [*_ahead(text, n.start(), "name"), *_behind(text, n.end(), "name")]
            side = "".join(x[5:] for x in beside if x[:7] in ("name:-1", "name:+1") and "=" not in x)
            out.append((n.start(), n.end(), "name", ["name:bias", *[f"name:{x}" for x in features], *beside, f"name:{ka}+{kb}{side}", f"name:{form}{side}"]))


STREET_WORDS = frozenset(STREETS["en"].split())


def _names_zh(text: str, lex: Lexicon, out: list) -> None:
    """Two or three ideographs behind a frequent family name, a rare ideograph, or a sign or word that opens a field."""
    for m in lex.zh_first.finditer(text):
        at = m.start()
        c, before = m.group(), text[at - 1 : at]
        kind = "common" if c in _COMMON_ZH else "rare" if c in lex.rare else "other" if before in ZH_OPENS else ""
        if not kind or (kind == "other" and c in ZH_GRAMMAR):
            continue
        first = ["name:bias", "name:zh", f"name:zh {kind}", f"name:zf={c}" if kind == "common" else "name:zf", *_ahead(text, at, "name")]
        if text[at : at + 2] in lex.han:
            first.append("name:zh pair is a word")
        if before + c in lex.han:
            first.append("name:zh runs on from a word")
        for k in (2, 3):
            given, after = text[at + 1 : at + k], text[at + k : at + k + 1]
            if len(given) < k - 1 or not _han(given[-1]):
                break
            rare = sum(x in lex.rare for x in given)
            features = first + [f"name:zh {k}", f"name:zg{sum(x in GIVEN_ZH for x in given)} of {k - 1}", f"name:zr{rare} of {k - 1}", *[f"name:zc={x}" for x in given], *_behind(text, at + k, "name")]
            if any(x in ZH_GRAMMAR for x in given):
                features.append("name:zh grammar inside")
            if k == 3 and given in lex.han:
                features.append("name:zh given is a word")
            if given[-1] + after in lex.han:
                features.append("name:zh runs into a word")
            if not _han(before or "a") and not _han(after or "a"):
                features.append("name:zh whole")
            if after and (after in GIVEN_ZH or after in lex.rare):
                features.append("name:zh next given")
            out.append((at, at + k, "name", features))


_COMMON_ZH = frozenset(FAMILY_ZH_COMMON + FAMILY_ZH_CLASSIC)
#: Words of grammar: no name begins with one of these. Then those that stand before names, signs, and the last signs of words for people.
ZH_GRAMMAR = frozenset("我你您他她它这那此的了着过是在有不也都就很没到从把被让给由和与跟对向为以于而或及一二三四五六七八九十两几每各某请问谁何后前中上下")
ZH_OPENS = frozenset("由和与跟给找让叫被请及同是人员者户长师友生：、；|:（(")


# --- the model -------------------------------------------------------------------------------
class SemiMarkovCRF:
    """Scores of whole segments; a labelling of a text is a set of segments that don't overlap.

    Text between segments scores 0, so the bounded-entity dynamic program runs over
    the ends of candidate segments only and is exact for the whole text.
    """

    def __init__(self, weights: dict[str, float], lex: Lexicon | None = None):
        self.weights, self.lex = weights, lex or lexicon()

    @classmethod
    def load(cls, path: str | Path = WEIGHTS) -> SemiMarkovCRF:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def score(self, features: list[str]) -> float:
        return sum(map(self.weights.get, features, repeat(0.0)))

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        found = candidates(text, self.lex)
        if not found:
            return []
        segments = sorted((end, start, kind, self.score(f)) for start, end, kind, f in found)
        segments = [s for s in segments if s[3] > 0]  # a segment below 0 is in no best labelling
        ends, best, back = [0], [0.0], [None]
        for end, start, kind, score in segments:
            at = bisect_right(ends, start) - 1
            total = best[at] + score
            if total > best[-1]:
                if ends[-1] == end:
                    best[-1], back[-1] = total, (at, start, end, kind)
                else:
                    ends.append(end), best.append(total), back.append((at, start, end, kind))
        out, at = [], len(ends) - 1
        while at > 0:
            at, start, end, kind = back[at]
            out.append((start, end, kind))
        return out[::-1]

    def marginals(self, segments: list[tuple[int, int, list[str]]]) -> list[float]:
        """Probability of each segment under the model, by forward and backward sums."""
        points = sorted({p for s, e, _ in segments for p in (s, e)})
        place = {p: i for i, p in enumerate(points)}
        n = len(points)
        ending, starting = [[] for _ in range(n)], [[] for _ in range(n)]
        scores = [self.score(f) for _, _, f in segments]
        for i, (s, e, _) in enumerate(segments):
            ending[place[e]].append(i)
            starting[place[s]].append(i)
        fwd, bwd = [0.0] * n, [0.0] * n
        lse = lambda xs: (m := max(xs)) + math.log(sum(math.exp(x - m) for x in xs))
        for p in range(n):
            fwd[p] = lse([fwd[p - 1] if p else 0.0, *(fwd[place[segments[i][0]]] + scores[i] for i in ending[p])])
        for p in range(n - 1, -1, -1):
            bwd[p] = lse([bwd[p + 1] if p + 1 < n else 0.0, *(bwd[place[segments[i][1]]] + scores[i] for i in starting[p])])
        return [math.exp(min(0.0, fwd[place[s]] + scores[i] + bwd[place[e]] - fwd[-1])) for i, (s, e, _) in enumerate(segments)]


OF_HAN = ("name:z", "name:h1=", "name:h2=", "name:n1=", "name:n2=")


def fit(examples: list[tuple[str, list[tuple[int, str]]]], epochs: int = 10, rate: float = 0.3, decay: float = 0.1, name_decay: float = 2e-3, least: int = 12, name_least: int = 120) -> SemiMarkovCRF:
    """Conditional likelihood by AdaGrad. An example is a text and its (start, kind) mentions.

    Of several candidates with the same start and kind the longest is the true one.
    Features of fewer than ``least`` examples get no weight (``name_least`` for names in letters, so that rare words of
    the sentences and single names weigh nothing).
    """
    data = []
    for text, gold in examples:
        found = [(s, e, k, f) for s, e, k, f in candidates(text)]
        if not found:
            continue
        true = set()
        for start, kind in gold:
            same = [i for i, (s, e, k, _) in enumerate(found) if s == start and k == kind]
            if same:
                true.add(max(same, key=lambda i: found[i][1]))
        data.append(([(s, e, f) for s, e, _, f in found], true))
    seen = Counter(x for segments, _ in data for x in {x for _, _, f in segments for x in f})
    data = [([(s, e, [x for x in f if seen[x] >= (name_least if x.startswith("name:") and not x.startswith(OF_HAN) else least)]) for s, e, f in segments], true) for segments, true in data]
    weights: dict[str, float] = {}
    squares: dict[str, float] = {}
    model = SemiMarkovCRF(weights)
    for _ in range(epochs):
        for segments, true in data:
            grad: dict[str, float] = {}
            for i, (p, (_, _, f)) in enumerate(zip(model.marginals(segments), segments)):
                if d := (i in true) - p:
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + d
            for x, g in grad.items():
                g -= (name_decay if x.startswith("name:") else decay) * weights.get(x, 0.0)
                squares[x] = squares.get(x, 1e-6) + g * g
                weights[x] = weights.get(x, 0.0) + rate * g / math.sqrt(squares[x])
    return model


def find_mentions(df: DataFrame, id_col: str, text_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """id, ``kind``, ``start_char``, ``end_char`` (code points) of every mention.

    One narrow stage over whole texts. Null and empty texts have none; a text
    repeated under other ids has its mentions under each. Only the two columns
    are read. The vocabularies of the word classes must lie in ``TOKENIZER_DIR`` on every executor.
    """
    weights = weights or SemiMarkovCRF.load().weights
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkovCRF(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                who, kinds, starts, ends = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for start, end, kind in model.decode(text):
                        who.append(i), kinds.append(kind), starts.append(start), ends.append(end)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(who, pa.int32())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                    names=["id", "kind", "start_char", "end_char"],
                )

    out = rows.mapInArrow(run, f"id {id_type}, kind string, start_char bigint, end_char bigint")
    return out.withColumnRenamed("id", id_col)


def mask(df: DataFrame, id_col: str, text_col: str, weights: dict[str, float] | None = None) -> DataFrame:
    """``df`` with mentions in ``text_col`` replaced by [EMAIL], [PHONE], [IDENTITY], [ADDRESS] and [NAME]; nulls stay."""
    weights = weights or SemiMarkovCRF.load().weights
    kept = [c for c in df.columns if c != text_col]
    rows = df.select(F.struct(*[df[c] for c in kept]).alias("row"), F.col(text_col).alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkovCRF(weights)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                if text:
                    parts, at = [], 0
                    for start, end, kind in model.decode(text):
                        parts += [text[at:start], f"[{kind.upper()}]"]
                        at = end
                    text = "".join(parts) + text[at:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, schema).select("row.*", F.col("text").alias(text_col))
