"""Text that was decoded with the wrong encoding (problem 8): a hidden Markov model over characters.

One state is clean text, every other one a pair of encodings (written in one, read in the other), and one stands for
characters that were lost. The observations are the characters outside ASCII and the class of what stands around
them. Each state emits a character given the one before it; the tables come from all documents and a few sentences:
for a pair they are counted on that clean text put through the pair. Viterbi labels the characters, and each labelled
span gets its state's inverse transform. Texts without characters outside ASCII take no part.
"""

from __future__ import annotations

import bisect
import codecs
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import spread

RATE_DOCS = 6_000  # the counts of a larger corpus are taken for so many documents, so that its size doesn't matter
COMMON = 5  # so many times as frequent as its inverse, a piece counts as clean

# Only for sample_chunks, which no query uses.
SAMPLE_DOCS = 6_000  # documents, by the order of a hash
SAMPLE_LENGTH = 20_000  # characters at most of each of them, so that the sample is bounded
SAMPLE_CHUNKS = 4_000  # most frequent pieces of them

# Fixed values: (written in, read in), once or, with a third entry, so many times over.
PAIRS = (
    ("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "latin-1", 2), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "mac_roman", 1),
    ("utf-8", "cp1250", 1), ("utf-8", "cp1251", 1), ("utf-8", "koi8-r", 1), ("utf-8", "cp866", 1), ("utf-8", "iso8859-2", 1), ("utf-8", "gbk", 1), ("utf-8", "cp932", 1),
    ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "mac_roman", 1), ("cp1252", "cp1251", 1), ("cp1252", "cp1250", 1), ("cp437", "cp1252", 1), ("cp850", "cp1252", 1), ("mac_roman", "cp1252", 1),
    ("cp1250", "cp1252", 1), ("iso8859-2", "cp1252", 1), ("cp1250", "iso8859-2", 1), ("cp1250", "cp437", 1), ("cp1250", "mac_roman", 1), ("cp852", "cp1252", 1), ("cp852", "cp1250", 1),
    ("cp1251", "cp1252", 1), ("cp1251", "koi8-r", 1), ("koi8-r", "cp1251", 1), ("koi8-r", "cp1252", 1), ("cp866", "cp1251", 1), ("cp866", "cp1252", 1), ("cp1251", "cp866", 1), ("iso8859-5", "cp1251", 1), ("cp1251", "mac_roman", 1), ("cp1251", "cp437", 1),
    ("euc_jp", "cp1252", 1), ("cp932", "cp1252", 1), ("euc_jp", "cp932", 1), ("cp932", "mac_roman", 1), ("cp932", "cp1250", 1), ("euc_jp", "cp1250", 1), ("gbk", "cp1252", 1),
)

# A little clean text per language, so that the tables exist for any corpus: articles of the Universal Declaration of
# Human Rights, and sentences in use to show a language's letters; none of it comes from a corpus.
SENTENCES = (
    "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat bei voller Gleichheit Anspruch auf ein gerechtes und öffentliches Verfahren. Niemand darf willkürlich in seinem Privatleben, seiner Familie, seiner Wohnung und seinem Schriftverkehr Eingriffen ausgesetzt werden",
    "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. Falsches Üben von Xylophonmusik quält jeden größeren Zwerg. Öl, Ärger, Übermut, Straße, Maß, heißt, daß, für, später, können, müssen, natürlich, schön, früh, fällt, läuft, zurück, nächste, größte",
    "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Toute personne a droit à l’éducation. L’éducation doit être gratuite, au moins en ce qui concerne l’enseignement élémentaire et fondamental. L’enseignement élémentaire est obligatoire",
    "Portez ce vieux whisky au juge blond qui fume. Voix ambiguë d’un cœur qui, au zéphyr, préfère les jattes de kiwis. Dès Noël, où un zéphyr haï me vêt de glaçons würmiens, je dîne d’exquis rôtis de bœuf au kir à l’aÿ d’âge mûr. École, État, À, Ça, où, déjà, même, après, très, été, là, voilà, reçu, « ainsi »",
    "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. La educación tendrá por objeto el pleno desarrollo de la personalidad humana y favorecerá la comprensión, la tolerancia y la amistad entre todas las naciones y todos los grupos étnicos o religiosos",
    "El pingüino Wenceslao hizo kilómetros bajo exhaustiva lluvia y frío; añoraba a su querido cachorro. El veloz murciélago hindú comía feliz cardillo y kiwi. La cigüeña tocaba el saxofón. ¿Qué día? ¡Ánimo! Él, Última, Época, así, más, está, aquí, también, después, según, todavía, señor, niño, mañana, ESPAÑA, ACCIÓN",
    "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Toda a pessoa tem direito à educação. A educação deve ser gratuita, pelo menos a correspondente ao ensino elementar fundamental; o ensino técnico e profissional deve ser generalizado; o acesso aos estudos superiores deve estar aberto a todos em plena igualdade",
    "Luís argüia à Júlia que «brações, fé, chá, óxido, pôr, zângão» eram palavras do português. À noite, vovô Kowalsky vê o ímã cair no pé do pinguim queixoso e vovó põe açúcar no chá de tâmaras do jabuti feliz. É, Às, Não, São, então, você, três, até, já, também, após, câmara, órgão, lição, REGIÃO, NAÇÕES",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do nauki. Nauka jest bezpłatna, przynajmniej na stopniu podstawowym i ogólnym. Nauka podstawowa jest obowiązkowa",
    "Pchnąć w tę łódź jeża lub ośm skrzyń fig. Zażółć gęślą jaźń. Mężny bądź, chroń pułk twój i sześć flag. Łąka, Śnieg, Żaba, Źrebię, Ćma, Óśmy, być, jeśli, który, również, więc, dziś, gdyż, możliwość, wyjście, później, między, będzie, został, własność, ŁÓDŹ, CZĘŚĆ",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на образование. Образование должно быть бесплатным по меньшей мере в том, что касается начального и общего образования. Начальное образование должно быть обязательным",
    "Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах. Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его достоинство обращению и наказанию. Все люди равны перед законом и имеют право, без всякого различия, на равную защиту закона. Каждый человек имеет право свободно передвигаться и выбирать себе местожительство в пределах каждого государства. Это право включает свободу беспрепятственно придерживаться своих убеждений и свободу искать, получать и распространять информацию и идеи любыми средствами и независимо от государственных границ",
    "Съешь же ещё этих мягких французских булок, да выпей чаю. Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. Эх, жираф! Это, Что, Как, Если, Для, Объём, Ёлка, Юг, Якорь, Цель, Щит, Шаг, Фонд, ПРАВО; его, ей, нас, вы, её, был, только, может, после, через, между, лишь",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、教育を受ける権利を有する。教育は、少なくとも初等の及び基礎的の段階においては、無償でなければならない。初等教育は、義務的でなければならない。",
    "すべて人は、生命、自由及び身体の安全に対する権利を有する。何人も、奴隷にされ、又は苦役に服することはない。奴隷制度及び奴隷売買は、いかなる形においても禁止する。何人も、拷問又は残虐な、非人道的な若しくは屈辱的な取扱若しくは刑罰を受けることはない。すべての人は、法の下において平等であり、また、いかなる差別もなしに法の平等な保護を受ける権利を有する。",
    "いろはにほへと ちりぬるを わかよたれそ つねならむ うゐのおくやま けふこえて あさきゆめみし ゑひもせす。トリナクコヱス ユメサマセ ミヨアケワタル ヒンカシヲ ソライロハエテ オキツヘニ ホフネムレヰヌ モヤノウチ。「カタカナ」、データ、ファイル、ページ、サーバー、ニュース、メッセージ（平成）・１２３年、です。ます。ください。",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Pijamalı hasta yağız şoföre çabucak güvendi. İyi, Şimdi, Çünkü, Ülke, Özgür",
    "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Înainte, Țară, Ștefan, aceşti, naţiune, câine, mâine",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Ξεσκεπάζω την ψυχοφθόρα βδελυγμία",
    "The façade of the naïve café — its owner’s résumé said “señor” – isn’t new… It weighs ½ of ±5 µg, was €15 and £12 before, near 20 °C → fine ✅ × ÷ § © ® ™ • Zürich Malmö Århus Łódź København",
    "\u00a0 \u00a0a\u00a0 \u202f \u2009 « \u3000 » • · × ÷ ° µ ± ½ ¼ ¾ ² ³ € £ ¥ § ¶ © ® ™ ← → ↑ ↓ ✓ ≤ ≥ ≠ ≈ ∞ √ α β γ δ π Ω „so“ ‚so‘ …",
)

# Letters of alphabets, each with a weight, so that no letter of theirs is a surprise.
ALPHABETS = (("àâäáãåæçéèêëíìîïñóòôöõøœßúùûüÿ", 0.5), ("ąćęłńóśźż", 0.5), ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", 0.5), ("čďěňřšťůýžľĺŕőűğışțșăđįųūėēāīļņķģ", 0.05), ("іїєґўџљњћђјѕ", 0.02), ("αβγδεζηθικλμνξοπρστυφχψωςάέήίόύώ", 0.05))

_CHUNK = r"[^\s]{0,12}[^\x00-\x7F][^\s]{0,24}"
_ASCII_WORDS = r"\s[\x00-\x7F]*\s"  # whole words, so that no piece is changed where they are left out
_RUN = re.compile(r"[^\x00-\x7f]+")
_WIDE_RUN = re.compile(r"[^\x00-\x7f](?:[\x40-\x7e]?[^\x00-\x7f])*[\x40-\x7e]?")  # second bytes may be ASCII
_MULTI = ("utf-8", "euc_jp", "cp932", "gbk")
_K = 4.0
_RARE_CLEAN, _RARE = 2e-5, 1e-7  # probability of a character that a table has never seen
ENTER, EXIT = math.log(2e-3), math.log(0.05)
CLEAN, LOST = 0, 1


class _Symbols(dict):
    """symbol() of characters met before."""

    def __missing__(self, c: str) -> str:
        if len(self) > 200_000:
            self.clear()
        s = self[c] = symbol(c)
        return s


def symbol(c: str) -> str:
    """A character outside ASCII stands for itself, but large scripts, emoji and ASCII classes are one symbol each."""
    o = ord(c)
    if o < 128:
        if c.isspace():
            return " "
        return "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else "!" if o >= 32 else "\x01"
    if o < 0x3000:
        return c
    if o < 0x3040:
        return "jp"
    if o < 0x30A0:
        return "hira"
    if o < 0x3100:
        return "kata"
    if 0x3400 <= o < 0xA000:
        return "kanji"
    if 0xAC00 <= o < 0xD7B0:
        return "hangul"
    if 0xE000 <= o < 0xF900:
        return "private"
    if 0xFF00 <= o < 0xFF61:
        return "wide"
    if 0xFF61 <= o < 0xFFA0:
        return "halfkana"
    if o == 0xFFFD:
        return c
    return "emoji" if o > 0xFFFF else "far"


_SYMBOLS = _Symbols()


def tokens(text: str) -> tuple[list[int], list[tuple[str, str]]]:
    """Positions and (previous symbol, symbol) of the characters outside ASCII and of the one after each run of them."""
    at: list[int] = []
    out: list[tuple[str, str]] = []
    n = len(text)
    for m in _RUN.finditer(text):
        s, e = m.span()
        prev = _SYMBOLS[text[s - 1]] if s else " "
        for i in range(s, e):
            cur = _SYMBOLS[text[i]]
            at.append(i)
            out.append((prev, cur))
            prev = cur
        at.append(e)
        out.append((prev, _SYMBOLS[text[e]] if e < n else " "))
    return at, out


def read_as(raw: bytes, encoding: str) -> str:
    """Decoding as careless programs do it: undefined bytes become the control characters of their number."""
    if encoding in ("gbk", "cp932", "euc_jp", "utf-8"):
        return raw.decode(encoding, "replace")
    return codecs.charmap_decode(raw, "strict", _single(encoding))[0]


@lru_cache
def _single(encoding: str) -> str:
    """The 256 characters of a single-byte encoding."""
    return "".join(_one(b, encoding) for b in range(256))


def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def bytes_of(text: str, encoding: str) -> bytes | None:
    """The bytes that :func:`read_as` turned into the text, or None."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError as e:
        if ord(text[e.start]) > 255:
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


def garble(text: str, pair: tuple[str, str, int]) -> str:
    written, read, times = pair
    for _ in range(times):
        text = read_as(text.encode(written, "ignore"), read)
    return text


def ungarble(text: str, pair: tuple[str, str, int]) -> str | None:
    """The inverse transform, or None where the text can't be what the pair makes."""
    written, read, times = pair
    for _ in range(times):
        raw = bytes_of(text, read)
        if raw is None:
            return None
        try:
            text = raw.decode(written)
        except UnicodeDecodeError:
            return None
    return text


def ungarble_parts(text: str, pair: tuple[str, str, int]) -> str | None:
    """The inverse transform where at least four of five bytes outside ASCII form characters; the others stay as they were read."""
    written, read, times = pair
    for _ in range(times):
        raw = bytes_of(text, read)
        if raw is None or len(raw) != len(text):
            return None
        out, at, lost = [], 0, 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode(written))
                break
            except UnicodeDecodeError as e:
                out += [raw[at : at + e.start].decode(written), text[at + e.start : at + e.end]]
                lost += e.end - e.start
                at += e.end
        if 5 * lost > sum(b > 127 for b in raw):
            return None
        text = "".join(out)
    return text


@dataclass
class Table:
    """Counts of (previous, symbol) of one state, and their smoothed log probability."""

    pair: dict = field(default_factory=dict)
    prev: dict = field(default_factory=dict)
    one: dict = field(default_factory=dict)
    n: float = 0.0
    rare: float = _RARE

    def add(self, toks: list[tuple[str, str]], weight: float) -> None:
        pair = self.pair
        for t in toks:
            pair[t] = pair.get(t, 0.0) + weight

    def more(self) -> "Table":
        """A table to go on with."""
        return Table(dict(self.pair), rare=self.rare)

    def close(self) -> "Table":
        """Sums over the pairs; the table is ready for use."""
        self.prev, self.one = {}, {}
        for (p, c), w in self.pair.items():
            self.prev[p] = self.prev.get(p, 0.0) + w
            self.one[c] = self.one.get(c, 0.0) + w
        self.n = sum(self.one.values())
        return self

    def log(self, p: str, c: str) -> float:
        one = 0.98 * self.one.get(c, 0.0) / max(self.n, 1e-9) + (_RARE if "\x80" <= c <= "\x9f" else self.rare)
        return math.log((self.pair.get((p, c), 0.0) + _K * one) / (self.prev.get(p, 0.0) + _K))


class Model:
    """The states' tables and the labelling of texts. States: clean, lost, then the pairs that occur."""

    def __init__(self, tables: list[Table], pairs: list[tuple[str, str, int]]):
        self.tables, self.pairs = tables, pairs
        self.n = len(tables) + 1
        self._forget()
        self._rivals: dict[frozenset, list[tuple[str, str, int]]] = {}

    def _forget(self) -> None:
        self._memo: dict[tuple[str, str], int] = {}
        self._rows = np.empty((1024, self.n))

    def _row(self, t: tuple[str, str]) -> int:
        """The row of ``_rows`` with the emissions of a token."""
        k = self._memo.get(t)
        if k is None:
            k = len(self._memo)
            if k == len(self._rows):
                self._rows = np.concatenate([self._rows, np.empty_like(self._rows)])
            p, c = t
            e = self._rows[k]
            e[CLEAN] = self.tables[0].log(p, c) if c != "�" else -30.0
            e[LOST] = 0.0 if c == "�" else (-1.5 if p == "�" and len(c) == 1 and ord(c) < 128 else -25.0)
            for i, t_ in enumerate(self.tables[1:]):
                e[2 + i] = t_.log(p, c)
            self._memo[t] = k
        return k

    def emission(self, t: tuple[str, str]) -> np.ndarray:
        k = self._row(t)  # may replace _rows
        return self._rows[k]

    def clean_log(self, text: str) -> float:
        return sum(float(self.emission(t)[CLEAN]) for t in tokens(text)[1])

    def label(self, seqs: list[list[tuple[str, str]]], enter_log: float = ENTER) -> list[np.ndarray]:
        """States of the tokens of several texts by Viterbi, step by step for all of them at once."""
        order = sorted((i for i in range(len(seqs)) if seqs[i]), key=lambda i: -len(seqs[i]))
        out: list = [np.zeros(0, dtype=np.int16)] * len(seqs)
        for lo in range(0, len(order), 256):
            part = order[lo : lo + 256]
            long, b = len(seqs[part[0]]), len(part)
            sizes = np.array([len(seqs[i]) for i in part])
            if len(self._memo) > 200_000:
                self._forget()
            rows = np.zeros((long, b), dtype=np.int32)
            known = self._memo.get
            for j, i in enumerate(part):
                rows[: sizes[j], j] = [self._row(t) if (k := known(t)) is None else k for t in seqs[i]]
            from_clean = np.zeros((long, b, self.n), dtype=bool)
            to_clean = np.zeros((long, b), dtype=np.int16)
            enter = np.full(self.n, enter_log - math.log(self.n))
            enter[CLEAN], enter[LOST] = 0.0, enter_log
            score = np.repeat(enter[None], b, axis=0) + self._rows[rows[0]]
            live = b
            for k in range(1, long):
                while sizes[live - 1] <= k:
                    live -= 1
                s = score[:live]
                e = self._rows[rows[k, :live]]
                new = s[:, :1] + enter
                came = new > s
                best = np.argmax(s[:, 1:], axis=1) + 1
                leave = s[np.arange(live), best] + EXIT
                out_of = leave > s[:, CLEAN]
                s_new = np.where(came, new, s)
                s_new[:, CLEAN] = np.where(out_of, leave, s[:, CLEAN])
                from_clean[k, :live] = came
                to_clean[k, :live] = np.where(out_of, best, CLEAN)
                score[:live] = s_new + e
            for j, i in enumerate(part):
                n = int(sizes[j])
                path = np.empty(n, dtype=np.int16)
                st = int(np.argmax(score[j]))
                for k in range(n - 1, -1, -1):
                    path[k] = st
                    if k:
                        st = int(to_clean[k, j]) if st == CLEAN else (CLEAN if from_clean[k, j, st] else st)
                out[i] = path
        return out

    def spans(self, text: str, at: list[int], toks: list[tuple[str, str]], path: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(start, end, state, log odds against clean) of the labelled stretches."""
        out = []
        k, n = 0, len(path)
        while k < n:
            s = int(path[k])
            if s == CLEAN:
                k += 1
                continue
            j = k
            odds = 0.0
            while j < n and path[j] == s:
                e = self.emission(toks[j])
                odds += float(e[s] - e[CLEAN])
                j += 1
            out.append((at[k], min(len(text), at[j - 1] + 1), s, odds))
            k = j
        return out

    def repair(self, text: str, at: list[int], toks: list[tuple[str, str]], path: np.ndarray, gain_least: float = 3.0, odds_least: float = 5.0) -> tuple[str, list[tuple[int, int, str, bool]]]:
        """(text with the spans restored, [start, end, pair, restored]) of the spans that hold against an exact check.

        The check: the inverse exists, and the clean state finds its result likelier by ``gain_least``. A span takes
        the whole of the runs it begins and ends in (of multi-byte pairs, if that has an inverse), since no encoding
        changes within a word; the likeliest spans go first.
        """
        found: list[tuple[int, int, str, bool, str]] = []
        taken: list[tuple[int, int]] = []
        free = lambda s, e: all(e <= a or s >= b for a, b in taken)
        runs: dict[bool, list[tuple[int, int]]] = {}
        spans = self.spans(text, at, toks, path)
        mine = {self.pairs[st - 2] for _, _, st, _ in spans if st != LOST and self.pairs[st - 2][0] in _MULTI}
        western = {"cp1252", "latin-1"}
        alike = lambda p, q: p[1] == q[1] and (p[0] == q[0] or (q[0] == "gbk" and p[0] in ("euc_jp", "cp932"))) or (p[0] == q[0] == "utf-8" and {p[1], q[1]} == western)
        key = frozenset(mine)
        if key not in self._rivals:
            self._rivals[key] = sorted(p for p in self.pairs if any(alike(p, q) for q in mine))
        rivals = self._rivals[key]

        def whole_runs(s: int, e: int, wide: bool) -> tuple[int, int]:
            if wide not in runs:
                runs[wide] = [m.span() for m in (_WIDE_RUN if wide else _RUN).finditer(text)]
            first = bisect.bisect_right(runs[wide], (s, len(text) + 1)) - 1
            last = bisect.bisect_left(runs[wide], (e, 0)) - 1
            return min(s, runs[wide][max(first, 0)][0]), max(e, runs[wide][max(last, 0)][1])

        def split(s: int, e: int, st: int, odds: float) -> list[tuple[int, int, int, float]]:
            """The span, or where a single-byte pair doesn't reach all of it, the stretches of runs between which it doesn't."""
            if st == LOST or self.pairs[st - 2][0] in _MULTI or ungarble(text[slice(*whole_runs(s, e, False))], self.pairs[st - 2]) is not None:
                return [(s, e, st, odds)]
            out, open_ = [], False
            for a, b in runs[False]:
                if b <= s or a >= e:
                    continue
                if ungarble(text[a:b], self.pairs[st - 2]) is None:
                    open_ = False
                elif open_:
                    out[-1] = (out[-1][0], b)
                else:
                    out.append((a, b))
                    open_ = True
            both = [(a, b, [self.emission(toks[k]) for k in range(bisect.bisect_left(at, a), bisect.bisect_left(at, b))]) for a, b in out]
            return [(a, b, st, float(sum(x[st] - x[CLEAN] for x in es))) for a, b, es in both]

        def widened(a: int, b: int, pair: tuple[str, str, int]) -> tuple[int, int]:
            """The stretch with the runs next to it that also read better after the inverse."""
            i, j = bisect.bisect_left(runs[False], (a, 0)) - 1, bisect.bisect_left(runs[False], (b, 0))
            for k, step in ((i, -1), (j, 1)):
                while 0 <= k < len(runs[False]):
                    c, d = runs[False][k]
                    new = ungarble(text[c:d], pair) if free(c, d) else None
                    if new is None or self.clean_log(f" {new} ") - self.clean_log(f" {text[c:d]} ") <= gain_least:
                        break
                    a, b = min(a, c), max(b, d)
                    k += step
            return a, b

        for s, e, st, odds in sorted((x for sp in spans for x in split(*sp)), key=lambda x: -x[3]):
            if st == LOST:
                if "\ufffd" in text[s:e] and free(s, e):
                    found.append((s, e, "lost", False, text[s:e]))
                continue
            pair, done = self.pairs[st - 2], None
            if pair[0] in _MULTI:  # of similar pairs, the one whose inverse reads best
                for p in rivals:
                    a, b = whole_runs(s, e, p[0] in ("cp932", "gbk"))
                    if free(a, b) and (new := ungarble(text[a:b], p)) is not None:
                        better = self.clean_log(new) / (b - a)
                        if done is None or better > done[4]:
                            done = (a, b, new, p, better)
                if done is None and free(s, e) and (new := ungarble(text[s:e], pair)) is not None:
                    done = (s, e, new, pair, 0.0)
            else:
                a, b = whole_runs(s, e, False)
                if free(a, b) and ungarble(text[a:b], pair) is not None:
                    a, b = widened(a, b, pair)
                    done = (a, b, ungarble(text[a:b], pair), pair, 0.0)
            whole = done is not None
            if not whole and pair[0] in _MULTI:
                a, b = whole_runs(s, e, pair[0] in ("cp932", "gbk"))
                if free(a, b):
                    new = ungarble_parts(text[a:b], pair)
                    done = (a, b, text[a:b] if new is None else new, pair, 0.0)
            if done is None:
                continue  # another span took the runs, or nothing is left that the pair reaches
            s, e, new, pair, _ = done
            piece = text[s:e]
            gain = self.clean_log(new) - self.clean_log(piece) if new != piece else 0.0
            several = pair[0] in ("utf-8", "euc_jp") or sum(len(r) for r in _RUN.findall(piece)) > 1
            if (new != piece and gain > gain_least and odds > (odds_least if several else 3 * odds_least)) or (new == piece and not whole and odds > 25.0):
                found.append((s, e, f"{pair[0]} as {pair[1]}" + (f" x{pair[2]}" if pair[2] > 1 else ""), whole and new != piece, new))
                taken.append((s, e))
        found = sorted(f for f in found if f[2] != "lost" or free(f[0], f[1]))
        parts, done_to = [], 0
        for s, e, _, _, new in found:
            parts += [text[done_to:s], new]
            done_to = e
        return "".join([*parts, text[done_to:]]), [f[:4] for f in found]


def _tables(toks: list[list[tuple[str, str]]], texts: list[str], weights: list[float], base: list[Table] | None = None) -> list[Table]:
    """Counts of the clean texts, and for each of PAIRS of what it makes of them; ``base``: counts to go on with."""
    out = [t.more() for t in base] if base else [Table(rare=_RARE_CLEAN), *(Table() for _ in PAIRS)]
    for t, w in zip(toks, weights):
        out[0].add(t, w)
    blocks = [chr(o) for lo, hi in ((0xA1, 0x180), (0x391, 0x3CA), (0x410, 0x452), (0x2010, 0x2027), (0x20A0, 0x20C0), (0x2190, 0x2194), (0x2264, 0x2266)) for o in range(lo, hi)]
    for pair, tab in zip(PAIRS, out[1:]):
        for t, w in zip(texts, weights):
            g = garble(t, pair)
            if g != t and not g.isascii():
                tab.add(tokens(g)[1], w)
        if pair[0] == "utf-8" and not base:
            for c in blocks:
                tab.add(tokens(f"a{garble(c, pair)}a")[1], 0.05)
    return [t.close() for t in out]


def _model(tables: list[Table]) -> Model:
    """The model of the pairs that make anything of the texts."""
    some = [(t, p) for t, p in zip(tables[1:], PAIRS) if t.n]
    return Model([tables[0], *(t for t, _ in some)], [p for _, p in some])


def known_words() -> list[tuple[str, float]]:
    """The sentences' words and the alphabets' letters, small and capital, with their weights."""
    out = [(f" {w} ", 5.0) for s in SENTENCES for w in s.split(" ") if not w.isascii()]
    out += [(w.upper(), 1.0) for w, _ in out if w.upper() != w]
    for letters, w in ALPHABETS:
        for c in letters:
            out += [(f"a{c}a", w), (f" {c}a", w / 3), (f"a{c} ", w / 3)]
            if c.upper() != c and len(c.upper()) == 1:
                out += [(f" {c.upper()}a", w / 2), (f"A{c.upper()}A", w / 4)]
    return out


_RUNNING = [i for i, p in enumerate(PAIRS, 1) if p[1] in ("gbk", "cp932")]  # states of pairs in which a character's bytes go to different readings by what stands before
_STEADY = [i for i in range(1, len(PAIRS) + 1) if i not in _RUNNING]
_WRITTEN = {w: sum(1 << i for i in _STEADY if PAIRS[i - 1][0] == w) for w in dict.fromkeys(p[0] for p in PAIRS)}
_HELD = 400_000  # sums that are kept before they are handed on


@lru_cache(200_000)
def _steady(c: str, state: int) -> str:
    """What a pair makes of a byte, given as the character of its number."""
    written, read, times = PAIRS[state - 1]
    return garble(read_as(c.encode("latin-1"), read), (written, read, times - 1))


@lru_cache(200_000)
def _changed(c: str) -> tuple[int, int]:
    """The steady states (as bits) in which a character comes out as another, and those in whose encoding it can't be written."""
    made = {i: garble(c, PAIRS[i - 1]) for i in _STEADY}
    return sum(1 << i for i, g in made.items() if g != c), sum(1 << i for i, g in made.items() if not g)


def count_neighbours(pieces: list[tuple[str, int]], into: dict[tuple[int, str, str], int]) -> None:
    """Adds what clean pieces give the tables, each so many times, by neighbours.

    Most pairs make the same of a byte wherever it stands; for these the keys are (states as bits, byte, next byte), so
    the pairs are worked out once per two bytes and not for every piece. For the others they are (-state, symbol,
    symbol), for the clean state (1, symbol, symbol). See :func:`spelt_out`.
    """
    texts: dict[tuple[int, int], list[str]] = {}  # all begin and end with a space
    for piece, n in pieces:
        text = f" {piece} "
        changed, cannot, never = 0, 0, -1
        for c in set(text):
            if c >= "\x80":
                x, y = _changed(c)
                changed, cannot, never = changed | x, cannot | y, never & y
        texts.setdefault((changed & ~cannot | 1, n), []).append(text)
        if some := cannot & ~never:
            for states in _WRITTEN.values():
                if states & some:
                    texts.setdefault((states, n), []).append("".join(c for c in text if c < "\x80" or not _changed(c)[1] & states))
        for i in _RUNNING:
            g = garble(text, PAIRS[i - 1])
            if g != text and not g.isascii():
                texts.setdefault((-i, n), []).append(g)
    for (states, n), some in texts.items():
        whole = "".join(some)
        if states < 0 or states & 1:
            for (a, b), k in Counter(zip(whole, whole[1:])).items():
                if a >= "\x80" or b >= "\x80":
                    key = (min(states, 1), _SYMBOLS[a], _SYMBOLS[b])
                    into[key] = into.get(key, 0) + n * k
        for written, of in _WRITTEN.items():
            if states > 0 and states & of:
                raw = whole.encode(written)
                for (x, y), k in Counter(zip(raw, raw[1:])).items():
                    if x > 127 or y > 127:
                        key = (states & of, chr(x) if x > 127 else _SYMBOLS[chr(x)], chr(y) if y > 127 else _SYMBOLS[chr(y)])
                        into[key] = into.get(key, 0) + n * k


def spelt_out(sums: dict[tuple[int, str, str], int]) -> dict[tuple[int, str, str], int]:
    """The counts of (state, previous symbol, symbol) that :func:`count_neighbours` gathered."""
    out: Counter = Counter()
    for (states, a, b), n in sums.items():
        if states <= 1:
            out[CLEAN if states == 1 else -states, a, b] += n
            continue
        for i in _STEADY:
            if states >> i & 1:
                prev = _steady(a, i)[-1]
                for c in _steady(b, i):
                    if prev >= "\x80" or c >= "\x80":
                        out[i, _SYMBOLS[prev], _SYMBOLS[c]] += n
                    prev = c
    return out


def verdicts(first: Model, chunks: list[str]) -> list[bool | str]:
    """Of each piece: True where it is garbled, False where it isn't, else what it was if it is."""
    texts = [f" {c} " for c in chunks]
    both = [tokens(t) for t in texts]
    out: list[bool | str] = [False] * len(chunks)
    for i, p in enumerate(first.label([x[1] for x in both])):
        if p.any():
            new, found = first.repair(texts[i], *both[i], p, 1.0, 0.0)
            if found:  # every text has an inverse of a single-byte pair, so that alone proves nothing
                out[i] = any(f[2].startswith(tuple(f"{m} " for m in _MULTI)) or f[2] == "lost" for f in found) or new.strip()
    # for UTF-8, whose inverse seldom exists by chance, rather too many left out than too few
    utf8 = np.array([False, False, *(p[0] == "utf-8" for p in first.pairs)])
    rest = [i for i, v in enumerate(out) if v is not True]
    for i, p in zip(rest, first.label([both[i][1] for i in rest], 2.0)):
        if utf8[p].any():
            _, found = first.repair(texts[i], *both[i], p, 1.0, 0.0)
            if any(f[2].startswith("utf-8 ") for f in found):
                out[i] = True
    return out


def _seeds() -> list[Table]:
    """The tables of the known words."""
    known = known_words()
    return _tables([tokens(w)[1] for w, _ in known], [w for w, _ in known], [x for _, x in known])


def _fitted(base: list[Table], counts: dict[tuple[int, str, str], int], unit: float) -> Model:
    """The model of the known words' tables and the counts, of which ``unit`` make one."""
    out = [t.more() for t in base]
    for (state, p, c), n in sorted(counts.items()):  # sums of floats depend on the order
        pair = out[state].pair
        pair[p, c] = pair.get((p, c), 0.0) + n / unit
    return _model([t.close() for t in out])


def fit(chunks: list[tuple[str, int]], docs: int = 0) -> Model:
    """Tables from known words, then from them and the pieces in which the first tables find nothing garbled.

    A piece that is far more frequent than what a single-byte pair would have made it from is clean. ``docs``: the
    number of documents that the pieces are from.
    """
    base, unit, often = _seeds(), max(1.0, docs / RATE_DOCS), dict(chunks)
    sums: dict[tuple[int, str, str], int] = {}
    of = verdicts(_model(base), [c for c, _ in chunks])
    count_neighbours([(c, n) for (c, n), v in zip(chunks, of) if v is False or (v is not True and n > COMMON * (unit + often.get(v, 0)))], sums)
    return _fitted(base, spelt_out(sums), unit)


def fit_documents(docs: DataFrame, text_col: str = "text") -> Model:
    """:func:`fit` on every piece of every document, whatever their number and length.

    Equal pieces are counted in one shuffle and judged once each; suspicious ones are joined with the pieces they
    would have been. Only sums by (state, previous symbol, symbol) reach the driver, whose number the alphabets bound.
    """
    spark = docs.sparkSession
    base = _seeds()
    model = _model(base)
    shared = spark.sparkContext.broadcast((model.tables, model.pairs))
    kind = "states bigint, a string, b string, n bigint"

    def summed(step: Callable[[list[tuple], dict], list[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """A step that adds to sums by (states, a, b) and returns further rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def arrow(rows: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["states", "a", "b", "n"])

            sums: dict[tuple[int, str, str], int] = {}
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for lo in range(0, batch.num_rows, 2048):
                    if more := step(list(zip(*(c[lo : lo + 2048] for c in columns))), sums):
                        yield arrow(more)
                    if len(sums) > _HELD:
                        yield arrow([(*k, n) for k, n in sums.items()])
                        sums.clear()
            if sums:
                yield arrow([(*k, n) for k, n in sums.items()])

        return run

    held: list[Model] = []  # one a task

    def judge(rows: list[tuple], sums: dict) -> list[tuple]:
        if not held:
            held.append(Model(*shared.value))
        of = verdicts(held[0], [c for c, _ in rows])
        count_neighbours([r for r, v in zip(rows, of) if v is False], sums)
        return [(None, c, v, n) for (c, n), v in zip(rows, of) if isinstance(v, str)]

    def count(rows: list[tuple], sums: dict) -> list[tuple]:
        count_neighbours(rows, sums)
        return []

    def spell(rows: list[tuple], sums: dict) -> list[tuple]:
        for k, n in spelt_out({(states, a, b): n for states, a, b, n in rows}).items():
            sums[k] = sums.get(k, 0) + n
        return []

    text = F.col(text_col)
    each = docs.where(text.rlike(r"[^\x00-\x7F]")).select(F.explode(F.array_append(F.regexp_extract_all(F.regexp_replace(text, _ASCII_WORDS, " "), F.lit(_CHUNK), F.lit(0)), F.lit(""))).alias("c"))  # '' counts the documents
    pieces = each.groupBy("c").agg(F.count("*").alias("n")).persist(StorageLevel.DISK_ONLY)
    judged = None
    try:
        number = pieces.where("c = ''").first()
        unit = max(1.0, (number.n if number else 0) / RATE_DOCS)
        pieces_only = pieces.where("c != ''")
        cores = spark.sparkContext.defaultParallelism
        few = pieces._jdf.queryExecution().toRdd().getNumPartitions() < cores
        judged = (pieces_only.repartition(cores) if few else pieces_only).mapInArrow(summed(judge), kind).persist(StorageLevel.DISK_ONLY)
        judged.count()  # two stages read it, which would judge each piece twice side by side
        inverse = pieces_only.select(F.col("c").alias("b"), F.col("n").alias("often"))
        common = judged.where("states is null").join(inverse, "b", "left").where(F.col("n") > COMMON * (unit + F.coalesce("often", F.lit(0)))).select("a", "n")
        sums = judged.where("states is not null").unionByName(common.mapInArrow(summed(count), kind)).groupBy("states", "a", "b").agg(F.sum("n").alias("n"))
        rows = sums.mapInArrow(summed(spell), kind).groupBy("states", "a", "b").agg(F.sum("n").alias("n")).collect()
    finally:
        pieces.unpersist()
        if judged is not None:
            judged.unpersist()
        shared.unpersist()
    return _fitted(base, {(r.states, r.a, r.b): r.n for r in rows}, unit)


def sample_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> list[tuple[str, int]]:
    """The most frequent pieces with characters outside ASCII of a bounded sample of documents, to look at a corpus or
    to try a fit; the queries' tables are those of :func:`fit_documents`.

    Documents whose hash lies below a threshold are looked at, set for twice SAMPLE_DOCS of all rows (whose number
    the files know); if too few of them have such characters, for four times as many, and so on. So a few times
    SAMPLE_DOCS rows reach the last step, whatever the corpus' size or parts. Of pieces that are as frequent, the
    ones with the lower hash are taken, so no script is left out by its place in the alphabet.
    """
    share = 2 * SAMPLE_DOCS / max(docs.count(), 1)
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    while True:
        near = docs.where(F.shiftrightunsigned(h, 1) < F.lit(int(share * 2**63))) if share < 1 else docs
        some = near.where((F.length(text_col) <= SAMPLE_LENGTH) & F.col(text_col).rlike(r"[^\x00-\x7F]")).select(id_col, text_col).orderBy(h, F.col(id_col)).limit(SAMPLE_DOCS)
        each = some.select(F.explode(F.array_append(F.expr(f"regexp_extract_all({text_col}, r'{_CHUNK}', 0)"), F.lit(""))).alias("c"))  # '' counts the documents
        rows = each.groupBy("c").count().orderBy(F.desc(F.col("c") == ""), F.desc("count"), F.xxhash64("c"), "c").limit(SAMPLE_CHUNKS + 1).collect()
        if share >= 1 or (rows and rows[0][1] >= SAMPLE_DOCS):
            return [(r[0], r[1]) for r in rows[1:]]
        share *= 4


def garbled_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_spans, encodings, restorable, text) of every document with at least one wrongly decoded stretch.

    ``text`` has the stretches restored where the inverse transform exists; ``restorable`` tells whether all were.
    Null, empty and pure ASCII texts aren't listed; repeated rows are listed each; the longest texts are read whole.
    """
    model = model or fit_documents(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.tables, model.pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), 2048):
                got = []
                part = texts[lo : lo + 2048]
                both = [tokens(t) for t in part]
                paths = own.label([x[1] for x in both])
                for d, t, (at, toks), p in zip(ids[lo : lo + 2048], part, both, paths):
                    if not p.any():
                        continue
                    new, found = own.repair(t, at, toks, p)
                    if found:
                        got.append((d, len(found), sorted({x[2] for x in found}), all(x[3] for x in found), new))
                if got:
                    c = list(zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.string())), pa.array(c[3], pa.bool_()), pa.array(c[4], pa.string())], names=["doc_id", "n_spans", "encodings", "restorable", "text"])

    src = spread(docs.where(F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text"))
    return src.mapInArrow(run, "doc_id bigint, n_spans int, encodings array<string>, restorable boolean, text string")
