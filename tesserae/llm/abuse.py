"""Scores for abusive, hateful and sexual language, in whole documents of several languages.

The words of the lexicon are held as a trie; a Levenshtein automaton of each unusual word of a text is run against it,
so that misspelled, stretched, masked and letter-spaced terms are found as well. Entries of several words continue the
words that the automaton gave. What a hit counts is decided by the window of words around it: an insult counts in full
where it is addressed to someone, a verb of harm where I announce it to you, a word of contempt where a group comes
before it. Within quotation marks beside words of reporting a hit counts nothing, and beside such words alone only if
the word of address stands right before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import abuse_lexicon as lex
from tesserae.llm.lookalikes import FOREIGN, INVISIBLE, LATIN

_CLASSES = (
    "INSULT", "SCORN", "CRUDE", "SLUR", "HARM", "HARM_YOU", "HARMED", "DYING", "PLACE", "GROUP", "GROUP_OF", "BASE", "CONTEMPT", "EXPEL", "SEXUAL", "BODY", "SEXUAL_YOU", "ASKED", "USED", "AIMED",
    "YOU", "YOURS", "PERSON", "SELF", "INTENT", "WISH", "SHOULD", "BE", "FILL", "DEAR", "REPORT",
)
(
    INSULT, SCORN, CRUDE, SLUR, HARM, HARM_YOU, HARMED, DYING, PLACE, GROUP, GROUP_OF, BASE, CONTEMPT, EXPEL, SEXUAL, BODY, SEXUAL_YOU, ASKED, USED, AIMED,
    YOU, YOURS, PERSON, SELF, INTENT, WISH, SHOULD, BE, FILL, DEAR, REPORT,
) = (1 << i for i in range(len(_CLASSES)))
LIKE, ALL, ANCHOR = 1 << 40, 1 << 41, 1 << 42
WEIGHT = {INSULT: 1.0, SCORN: 0.7, CRUDE: 0.8, SLUR: 1.2}
RUDE = INSULT | SCORN | CRUDE | SLUR

_WORDS: dict[str, int] = dict.fromkeys("like comme wie como".split(), LIKE) | dict.fromkeys("all alle tous toutes todos todas".split(), ALL)
#: Entries of several words by their first one.
_PHRASES: dict[str, list[tuple[tuple[str, ...], int]]] = {}
for _i, _name in enumerate(_CLASSES):
    for _e in getattr(lex, _name):
        _p = tuple(_e.split())
        if len(_p) == 1:
            _WORDS[_e] = _WORDS.get(_e, 0) | 1 << _i
        else:
            _PHRASES.setdefault(_p[0], []).append((_p, 1 << _i))
            # a sentence is looked into for the phrase if it holds the longest of its words
            _w = max(_p, key=len)
            _WORDS[_w] = _WORDS.get(_w, 0) | ANCHOR

_LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e"}
_MASK = "*#"


class LexiconTrie:
    """Words in a trie; search runs the Levenshtein automaton of a word along it."""

    def __init__(self, words: list[str]):
        self.root: dict = {}
        self.words = sorted(set(words))
        for word in self.words:
            node = self.root
            for ch in word:
                node = node.setdefault(ch, {})
            node[""] = word

    def search(self, word: str, most: int, same_start: bool = True) -> tuple[int, str] | None:
        """(edits, word) of the nearest word within most edits, the first in order on ties.

        A sign that stands for a letter is that letter, a masking sign any one letter, and a letter repeated costs
        nothing. The automaton's state after a path is the row of costs of that path to each beginning of the word;
        a branch is left as soon as all of the row exceeds the bound.
        """
        best: tuple[int, str] | None = None
        n = len(word)
        start = self._first(word)
        stack = [(self.root[c], self._step(start, word, c)) for c in self.root if c and (not same_start or c == word[0] or c in _LOOKS.get(word[0], ""))]
        while stack:
            node, row = stack.pop()
            if min(row) > most:
                continue
            term = node.get("")
            if term is not None and row[n] <= most and (best is None or (row[n], term) < best):
                best = (row[n], term)
            stack += [(nxt, self._step(row, word, c)) for c, nxt in node.items() if c]
        return best

    @staticmethod
    def _again(word: str, i: int) -> bool:
        return i > 0 and word[i] == word[i - 1] and word[i] not in _MASK

    def _first(self, word: str) -> list[int]:
        row = [0]
        for i in range(len(word)):
            row.append(row[i] + (not self._again(word, i)))
        return row

    def _step(self, row: list[int], word: str, c: str) -> list[int]:
        out = [row[0] + 1]
        for i, w in enumerate(word):
            same = w == c or w in _MASK or c in _LOOKS.get(w, "")
            out.append(min(row[i] + (not same), row[i + 1] + 1, out[i] + (not self._again(word, i))))
        return out


TRIE = LexiconTrie([w for name in ("INSULT", "SCORN", "CRUDE", "SLUR") for w in getattr(lex, name) if " " not in w] + ["piece"])

EXACT, DISGUISED, MISSPELT = 0, 1, 2
_SEEN: dict[str, tuple[str, int]] = {}


def restore(token: str) -> tuple[str, int]:
    """The word of the lexicon that a lower-cased token stands for, and how; the token itself if it stands for none.

    Words of six letters and more may hold one misspelling, of eleven and more, or of eight if disguised, two. Tokens of
    any length are looked at.
    """
    got = _SEEN.get(token)
    if got is None:
        if len(_SEEN) > 300_000:
            _SEEN.clear()
        _SEEN[token] = got = _restore(token)
    return got


def _restore(token: str) -> tuple[str, int]:
    n = len(token)
    if token in _WORDS or token in lex.ORDINARY:
        return token, EXACT
    letters = sum(c.isalpha() for c in token)
    if 1 < n < 6:
        # short words of phrases, if signs stand in them or a letter is stretched
        plain = "".join(_LOOKS.get(c, c)[0] for c in token) if 0 < letters < n else _STRETCH.sub(r"\1", token)
        if plain != token and plain in _WORDS:
            return plain, DISGUISED
    if n < 3:
        return token, EXACT
    if letters == n:
        stretched = any(token[i] == token[i - 1] == token[i - 2] for i in range(2, n))
        doubled = n > 4 and any(token[i] == token[i - 1] for i in range(1, n))
        most = (1 if n >= 6 else 0) if n < 11 else 2
        if not stretched and not doubled and not most:
            return token, EXACT
        found = TRIE.search(token, most)
        if found is None:
            return token, EXACT
        return found[1], DISGUISED if found[0] == 0 and stretched else MISSPELT
    masks = sum(c in _MASK for c in token)
    signs = sum(c in _LOOKS for c in token)
    if letters + masks + signs < n or not token[0].isalnum():
        return token, EXACT
    if masks:
        if letters < 2 or n < 4:
            return token, EXACT
        found = TRIE.search(token, 0)
        # a masked word is as long as what it masks
        return (found[1], DISGUISED) if found and len(found[1]) == n else (token, EXACT)
    if letters < 2 and n < 6:
        return token, EXACT
    found = TRIE.search(token, 2 if letters and n >= 8 else 1 if n >= 6 and letters > 1 else 0)
    return (found[1], DISGUISED) if found else (token, EXACT)


_STRETCH = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<![\w*])[^\W\d_](?: [^\W\d_]){3,}(?![\w*])")
_SPACED_HINT = re.compile(r" [^\W\d_] [^\W\d_] [^\W\d_](?![\w*])")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$€#]|[!|](?=\w))*|\S")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)]*\s+|\n+")
_ODD = re.compile(f"[{FOREIGN}{INVISIBLE}]")
_CODE = re.compile(r"[A-Z]+\d+[A-Z]?\b")
_EDGE = ".,;:!?()[]\"'“”„«»…-"
_FOLD = str.maketrans(FOREIGN, LATIN)
_DROP = str.maketrans("", "", INVISIBLE)
_OPEN, _CLOSE = "“„«‘‚", "”»’"
_RAW: dict[str, int] = {}


def _plain(text: str) -> str:
    if text.isascii():
        return text
    t = unicodedata.normalize("NFKC", text)
    if _ODD.search(t):
        t = t.translate(_DROP)
        t = re.sub(r"\w+", lambda m: m.group().translate(_FOLD) if re.search("[A-Za-z]", m.group()) else m.group(), t)
    return t


def _join_spaced(m: re.Match) -> str:
    """Letters set apart; the article before them may have been caught as well."""
    word = m.group().lower().replace(" ", "")
    for head, rest in (("", word), ("a ", word[1:] if word[0] == "a" else "")):
        if len(rest) > 3 and _WORDS.get(restore(rest)[0], 0) & (RUDE | SEXUAL | HARM):
            return head + restore(rest)[0]
    return m.group()


class _Sentence:
    """The tokens of one sentence with their classes, which of them are quoted, and how each was found."""

    def __init__(self, sentence: str):
        s = _SPACED.sub(_join_spaced, _CODE.sub(" ", sentence)).lower().replace("so-called", "socalled").replace("'s ", " ")
        pairs = [(m.group(), *restore(m.group())) for m in _TOKEN.finditer(s)]
        self.raw, self.tok, self.how = zip(*pairs, strict=True) if pairs else ((), (), ())
        self.cls = [_WORDS.get(t, 0) for t in self.tok]
        self.phrase: dict[int, tuple[str, ...]] = {}
        for i, t in enumerate(self.tok):
            for p, bit in _PHRASES.get(t, ()):
                if self.tok[i : i + len(p)] == p:
                    self.cls[i] |= bit
                    if bit == AIMED:
                        self.phrase[i] = p
        self.quoted = self._quotes()
        self.all = 0
        for c in self.cls:
            self.all |= c

    def _quotes(self) -> list[bool]:
        """Tokens between quotation marks that are closed within the sentence."""
        out, begin = [False] * len(self.tok), -1
        for i, t in enumerate(self.tok):
            if t in _OPEN or (t == '"' and begin < 0):
                begin = i if begin < 0 else begin
            elif begin >= 0 and (t in _CLOSE or t == '"') and not (t == "’" and i + 1 < len(self.tok) and self.tok[i + 1] in ("s", "t", "re", "ll")):
                out[begin : i + 1] = [True] * (i + 1 - begin)
                begin = -1
        return out

    def near(self, lo: int, hi: int, bits: int) -> bool:
        return any(c & bits for c in self.cls[max(0, lo) : max(0, hi + 1)])

    def address(self, i: int) -> int:
        """How the word at i is addressed: 2 right after 'you' or the like, 1 otherwise to someone, 0 not at all."""
        tok, cls = self.tok, self.cls
        j = i - 1
        while j >= 0 and i - j < 9 and cls[j] & (FILL | RUDE) and not cls[j] & (YOU | PERSON | DEAR):
            j -= 1
        if i + 2 < len(tok) and cls[i + 1] & LIKE and cls[i + 2] & YOU:
            return 2
        if j < 0:
            return 0
        if cls[j] & YOU:
            return 2
        ambiguous = tok[i] in lex.AMBIGUOUS
        if cls[j] & BE and not cls[j] & DEAR:
            if self.near(j - 1, j - 1, YOU | PERSON) or self.near(j - 3, j - 1, YOURS):
                return 2 if self.near(j - 1, j - 1, YOU) else 1
            return 0
        if cls[j] & DEAR:
            return 0 if ambiguous and i - j > 1 and tok[j] != "dear" else 1
        if tok[j] == ":":
            return int(self.near(j - 4, j - 1, YOU | PERSON))
        if tok[j] == "," and (i + 1 == len(tok) or tok[i + 1] in ",.!?;" or cls[i + 1] & SCORN):
            return int(self.near(j - 4 if ambiguous else j - 16, j - 1, YOU | AIMED if ambiguous else YOU | YOURS | PERSON | AIMED))
        return 0

    def reported(self, i: int) -> bool:
        if self.quoted[i] and self.near(i - 15, i + 15, REPORT):
            return True
        return (self.near(i - 5, i - 1, REPORT) or self.near(i + 1, i + 5, REPORT)) and self.address(i) < 2

    def rude(self) -> float:
        total = 0.0
        for i, c in enumerate(self.cls):
            if not c & RUDE or self.reported(i):
                continue
            weight = max(w for bit, w in WEIGHT.items() if c & bit)
            to = self.address(i)
            if to:
                share = 1.0
            elif c & SLUR:
                share = 0.85
            elif self.how[i] == MISSPELT or self.tok[i] in lex.AMBIGUOUS:
                share = 0.0
            elif self.near(i - 2, i - 1, YOURS):
                share = 0.6
            else:
                share = 0.4 if self.near(i - 4, i + 4, YOU) else 0.15
            total += weight * share
        return min(2.5, total)

    def harm(self) -> float:
        out = 0.0
        for i, c in enumerate(self.cls):
            if c & (HARM | HARM_YOU | PLACE):
                who = next((j for j in range(i - 1, max(-1, i - 16), -1) if self.cls[j] & SELF), None)
                announced = who is not None and self.near(who, i, INTENT) and not {"not", "nicht", "pas", "no", "never"} & set(self.tok[who:i])
                if announced and c & HARM and self.near(who, i + 6, YOU | YOURS) and not self.reported(i):
                    out = max(out, 1.3)
                elif announced and c & HARM_YOU and self.near(i - 3, i + 1, YOU) and not self.reported(i):
                    out = max(out, 1.3)
                elif c & PLACE and who is not None and {"ever", "again", "next", "catch"} & set(self.tok[max(0, who - 2) : i]) and self.near(i - 8, i, YOU) and self.near(i - 8, i, INTENT) and not self.reported(i):
                    out = max(out, 1.3)
            if c & (HARMED | DYING) and not self.reported(i):
                meant = self.near(i - 16, i + 4, YOU | PERSON | GROUP)
                wished = self.near(i - 12, i - 1, WISH) or (c & HARMED and self.near(i - 7, i - 1, SHOULD) and self.near(i - 2, i - 1, BE | SHOULD | FILL))
                if meant and wished:
                    out = max(out, 1.3)
        return out

    def group(self) -> float:
        out = 0.0
        for g, c in enumerate(self.cls):
            if c & GROUP_OF and g + 1 < len(self.tok) and (self.tok[g + 1].endswith("s") or self.tok[g + 1] in ("people", "men", "women", "leute", "menschen")):
                c |= GROUP
            many = c & ALL and g + 2 < len(self.tok) and self.tok[g + 1].endswith("s") and self.cls[g + 2] & BE
            if not c & GROUP and not many:
                continue
            for i in range(g + 1, min(len(self.tok), g + 20)):
                d = self.cls[i]
                base = d & BASE and any(self.cls[j] & BE for j in range(max(g + 1, i - 3), i)) and i - g < 9
                said = d & CONTEMPT and c & GROUP
                expelled = d & EXPEL and self.near(i - 5, i - 1, SHOULD)
                if (base or said or expelled) and not self.reported(i):
                    out = max(out, 1.5 if base else 1.3)
        return out

    def sexual(self) -> float:
        out = 0.0
        body = sum(1 for c in self.cls if c & (BODY | SEXUAL))
        wanted = {"want", "quiero", "veux", "will"} if self.all & SEXUAL else {"want", "quiero", "veux"}
        for i, c in enumerate(self.cls):
            if c & USED and self.near(i, i + 9, SEXUAL | BODY) and not self.reported(i):
                out = max(out, 1.5)
            strong = c & SEXUAL or (c & BODY and body > 1 and self.near(i - 3, i + 3, YOURS)) or (c & SEXUAL_YOU and self.near(i + 1, i + 1, YOU) and body)
            if not strong and not (c & BODY and self.near(i - 6, i, ASKED) and self.near(i - 4, i + 4, YOURS)) and not (self.tok[i] == "screw" and self.near(i + 1, i + 1, YOU)):
                continue
            if not self.near(i - 12, i + 6, YOU | YOURS) or self.reported(i):
                continue
            if self.near(i - 8, i, ASKED) or (self.near(i - 10, i, SELF) and (c & ~BODY & (SEXUAL | SEXUAL_YOU) or wanted & set(self.tok[max(0, i - 8) : i])) and self.near(i - 8, i, INTENT) and self.near(i - 3, i + 3, YOU | YOURS)):
                out = max(out, 1.3)
        return out

    def phrases(self) -> float:
        out = 0.0
        for i, c in enumerate(self.cls):
            if c & AIMED and not self.reported(i):
                p = self.phrase.get(i, (self.tok[i],))
                own = len(p) == 1 or any(_WORDS.get(w, 0) & (YOU | YOURS) for w in p)
                if own or self.near(i - 10, i + len(p) + 10, YOU | YOURS | PERSON):
                    out += lex.AIMED[" ".join(p)]
        return min(out, 2.6)

    def score(self) -> float:
        out = self.rude() if self.all & RUDE else 0.0
        if self.all & (HARM | HARM_YOU | HARMED | DYING | PLACE):
            out += self.harm()
        if self.all & (GROUP | GROUP_OF | ALL):
            out += self.group()
        if self.all & (SEXUAL | BODY | SEXUAL_YOU | USED):
            out += self.sexual()
        return out + (self.phrases() if self.all & AIMED else 0.0)


def sentence_score(sentence: str) -> float:
    """What one sentence counts; sentence is in plain letters, any case."""
    return _Sentence(sentence).score()


#: Of each set of classes a sentence must hold one of each to be looked at; words of phrases stand for all classes that phrases have.
_GATES = (
    (RUDE,),
    (ANCHOR,),
    (HARM | HARM_YOU, SELF, YOU | YOURS),
    (PLACE, YOU, SELF),
    (HARMED | DYING, WISH | SHOULD, YOU | PERSON | GROUP),
    (GROUP | GROUP_OF | ALL, BASE | CONTEMPT | EXPEL),
    (SEXUAL | BODY | SEXUAL_YOU, YOU | YOURS, SELF | ASKED),
    (AIMED,),
)


def _open(mask: int) -> bool:
    return any(all(mask & g for g in gate) for gate in _GATES)


def _mask(raw: str) -> int:
    """The classes of what a run of characters without space holds."""
    got = _RAW.get(raw)
    if got is None:
        if len(_RAW) > 300_000:
            _RAW.clear()
        got = 0
        for m in _TOKEN.finditer(_CODE.sub(" ", raw).lower()):
            got |= _WORDS.get(restore(m.group())[0], 0)
        _RAW[raw] = got
    return got


#: Sentences that count less, such as a term that is addressed to nobody, never add up.
LEAST = 0.5


def document_score(text: str) -> float:
    """The sum over the sentences that count LEAST or more; only those with the classes that some rule needs are looked at."""
    t = _plain(text)
    held = 0
    for x in set(t.split()):
        held |= _mask(x)
    spaced = _SPACED_HINT.search(t) and _SPACED.search(t)
    if not spaced and not _open(held):
        return 0.0
    total = 0.0
    for s in _SENTENCE.split(t):
        mask = 0
        for x in s.split():
            mask |= _mask(x)
        if _open(mask) or (spaced and _SPACED.search(s)):
            got = sentence_score(s)
            total += got if got >= LEAST else 0.0
    return total


THRESHOLD = 1.0


def score_documents(df: DataFrame, text: str, score: str = "score", threshold: float = THRESHOLD, flagged: str = "flagged") -> DataFrame:
    """df without its text, with a score (double, 0 to 1) and whether it reaches the threshold on the summed scale.

    The score is 1 - exp(-sum) of what the sentences count. Null and empty texts score 0; repeated rows stay repeated;
    columns with the new names are replaced. One pass over whole texts, no shuffle.
    """
    keep = [c for c in df.columns if c not in (text, score, flagged)]
    src = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = df.select(*[f"`{c}`" for c in keep]).schema.add(score, T.DoubleType()).add(flagged, T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            raw = np.asarray([document_score(t) if t else 0.0 for t in rb.column(rb.num_columns - 1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], pa.array(np.round(1 - np.exp(-raw), 6)), pa.array(raw >= threshold - 1e-9)], names=[*keep, score, flagged])

    return src.mapInArrow(run, schema)


def rates(scored: DataFrame, by: str, flagged: str = "flagged") -> DataFrame:
    """(by, documents, flagged, rate) for each value of a column, null among them; repeated rows count each."""
    return scored.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.col(flagged).cast("long")).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))
