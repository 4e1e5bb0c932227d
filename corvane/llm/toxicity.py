"""Toxicity scores of text restored by noisy-channel decoding.

1. Character model: trigram counts of letters and boundaries over every text.
2. Clues: a clue is a word prefix (so that inflected and compound forms count together) that occurs at least once, twice or three
   times in a text. On a bounded sample of labelled rows (``SAMPLE_ROWS``, the lowest hashes of the id; held-out rows
   are never used; one row of those that share a min-hash of their word shingles, so that copies lend no weight) clues are counted by
   class. Clues whose toxic share is surely above ``LEAST_SHARE`` (Wilson bound at three deviations) are taken strongest first; a
   weaker one only if it also marks toxic texts that stronger ones leave unmarked.
3. Restoration: tokens with look-alike symbols, repeated letters or spaced-out letters become a lattice of characters (a symbol
   may be any letter it resembles, a run may be one letter, a separator may be nothing or a boundary). Viterbi search finds
   the likeliest reading under the channel's costs and the character model, which mixes the corpus trigrams with
   the letter sequences of the clues. Plain tokens have one path only and stay as they are. Tokens and spaced runs of any length are
   decoded whole. Four digits in a row are first read as a number and four wildcards in a row as a gap: both part a token. A token
   joined by ``-`` or ``_`` is read part by part, or as one if that shows more clues or its parts are single letters.
   What this leaves without a clue (numbers, tokens without letters, wide or odd spacing) gets a second reading, in which wildcards stand for the letters
   that continue a clue only. It is taken if it is one word that begins with a clue and likelier than an arbitrary string of ``SYMBOLS`` symbols;
   where wildcards outnumber the other symbols more than two to one, too much is hidden, and there is none.
4. Score: a logistic model of the clues in the restored text, fitted on the same sample, restored in the same way. What can show no clue in any reading
   (``places``) is not restored for a score; that changes none.

Only the text enters a score. Defined results: null and empty texts get the score of a text without clues; very long texts are read whole;
labels with null ``toxic`` are not used; repeated rows get equal scores; equally likely readings: the first found stays; without labels nothing is
toxic; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, read_table
from .workers import fresh

SAMPLE_ROWS = 20_000
PREFIXES = range(3, 13)
LEVELS = 3
LEAST_TEXTS = 4
LEAST_SHARE, SURE_SHARE = 0.5, 0.75
THRESHOLD = 0.7
ORDER = 27  # a boundary and 26 letters
SYMBOLS = 50  # of which a string without sense is made: letters, digits and marks
BLOCK = 1 << 20

#: Letters that a symbol may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz", "#": "abcdefghijklmnopqrstuvwxyz"}
SEPARATORS = " ._-*/\t\n"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SPACED = re.compile(r"(?<![^\s])[a-z0-9@$!|](?:[ ._*/\t\n-]{1,2}[a-z0-9@$!|]){2,}(?![^\s.,;:!?])")
EDGES = ".,;:?!\"'()[]{}<>#%&|*-_~=+/\\…«»“”„"
#: Single symbols at any distance, among them those that ``SPACED`` lacks; no character is both a symbol and a separator.
WIDE = re.compile(r"(?<![^\s])[a-z0-9@$!|+(#*€£¡](?:[ ._/\t\n-]+[a-z0-9@$!|+(#*€£¡]){2,}(?![^\s.,;:!?])")
APART = re.compile(WIDE.pattern + "|" + SPACED.pattern)
GAPS = re.compile(r"([ ._/\t\n-])[ ._/\t\n-]+")
WILD = re.compile(r"[*#]")
SPLIT = re.compile(r"[.,;:?\"/\\\[\]{}<>=~&%]+")
NUMBERS = re.compile(r"[0-9]{4,}|[*#]{4,}")
JOINTS = re.compile(r"[-_]+")
RUNS = re.compile(r"(.)\1*", re.DOTALL)
SPACE = re.compile(r"\s")
SHORT = 40  # symbols of a group that are looked through at a place
DOUBLE = re.compile(r"([^\W\d_])\1")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
CLASSES = np.zeros(256, np.int64)
CLASSES[[*range(97, 123)]] = CLASSES[[*range(65, 91)]] = np.arange(1, 27)


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts: ``ORDER ** 3`` numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        total = np.zeros(ORDER**3, np.int64)
        for batch in batches:
            codes = np.frombuffer("\n\n".join(["", *batch.column("text").fill_null("").to_pylist(), ""]).encode(), np.uint8)
            for at in range(0, len(codes) - 2, BLOCK):
                c = CLASSES[codes[at : at + BLOCK + 2]]
                total += np.bincount(c[:-2] * ORDER**2 + c[1:-1] * ORDER + c[2:], minlength=ORDER**3)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0], pa.int64())], ["at", "n"])

    sums = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ORDER**3, np.int64)
    for at, n in sums:
        counts[at] = n
    return counts.reshape(ORDER, ORDER, ORDER)


def places(clues: list[str]) -> re.Pattern | None:
    """Finds every place in a lower-case text from which some reading, the first or the second, may show a clue, and some others.

    A reading begins a word at the start or after a symbol that is no letter, and then takes for each letter of the clue the letter or look-alikes
    of it, repeated or not, and any separators. Neighbouring letters that share a symbol are one group here, so that a group ends where its symbols do and
    the search never goes back. A group of more than ``SHORT`` symbols is a place whatever follows, so that each costs bounded work, and so is a wildcard."""
    if not clues:
        return None
    skipped = set(SEPARATORS) - set("*#")
    symbols = {letter: {letter, *(c for c, meant in LOOKALIKES.items() if letter in meant and c not in "*#")} for letter in set("".join(clues))}
    tree: dict = {}
    for clue in sorted(clues):
        groups: list[tuple[set[str], int]] = []  # symbols, and the letters they stand for
        for letter in clue:
            group, n = symbols[letter], 1
            while groups and groups[-1][0] & group:
                before, m = groups.pop()
                group, n = group | before, n + m
            groups.append((group, n))
        node = tree
        for group, n in groups:
            node = node.setdefault((frozenset(group), n), {})
        node[None] = {}  # a clue ends here

    def one_of(chars: set[str]) -> str:
        return "[" + "".join(map(re.escape, sorted(chars))) + "]"

    def pattern(node: dict) -> str:
        ways = []
        for (group, n), after in node.items():
            more = one_of({*group, *skipped})
            rest = "" if None in after else f"{more}{{0,{SHORT}}}+(?:{more}|{pattern(after)})"
            ways.append(f"{one_of(group)}{more}{{{n - 1}}}{rest}")
        return f"(?:{'|'.join(ways)})"

    first = one_of(set("*#").union(*(group for group, _ in tree)))
    return re.compile(f"{first}(?:(?<=[*#])|(?<![a-z].)(?<=(?={pattern(tree)}).))", re.DOTALL)


class Restorer:
    """Viterbi decoding of tokens; keeps what it has decoded."""

    CACHE = 250_000

    def __init__(self, counts: np.ndarray, clues: list[str]):
        tri = counts.astype(float)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + ORDER)
        p2 = (bi + 20 * p1) / (bi.sum(axis=1, keepdims=True) + 20)
        self.corpus = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
        self.clues = {clue: i for i, clue in enumerate(clues)}
        self.lengths = sorted({len(clue) for clue in clues})
        self.ahead: dict[str, set[str]] = {}
        for clue in clues:
            for i, letter in enumerate(clue):
                self.ahead.setdefault(clue[:i], set()).add(letter)
        self.follow: dict[str, Counter] = {}
        for word in clues:
            padded = f"   {word}"
            for i in range(3, len(padded)):
                self.follow.setdefault(padded[i - 3 : i], Counter())[padded[i]] += 1
        self.seen: dict[str, tuple[tuple[str, ...], tuple[int, ...]]] = {}
        self.places = places(clues)

    def _log_p(self, last: str, letter: str) -> float:
        at = [LETTERS.find(c) + 1 for c in (last[-2], last[-1], letter)]
        p, after = self.corpus[at[0], at[1], at[2]], self.follow.get(last)
        return math.log(0.5 * p + 0.5 * after[letter] / after.total() if after else 0.5 * p)

    def _edges(self, c: str, i: int, run: int) -> list[tuple[int, str, float]]:
        """(end, letter, cost) of the readings of ``c`` at place ``i``, which stands there ``run`` times in a row."""
        found = []
        if c in LETTERS:
            found.append((i + 1, c, -0.1))
            if run > 1:
                found.append((i + run, c, -0.7 if run > 2 else -2.3))
        else:
            letters = LOOKALIKES.get(c, "")
            cost = -1.0 - math.log(max(1, len(letters)))
            found += [(i + 1, letter, cost) for letter in letters]
            if run > 1:
                found += [(i + run, letter, cost - (0.7 if run > 2 else 2.3)) for letter in letters]
            if c in SEPARATORS:
                found.append((i + 1, "", -0.5))
            found.append((i + 1, " ", -2.5))
        return found

    def decode(self, seen: str) -> str:
        return self._likeliest(seen)[1]

    def _likeliest(self, seen: str, known: bool = False) -> tuple[float, str]:
        """The likeliest reading and its score; states are the last three characters, and each keeps the way it was reached. If ``known``, a
        wildcard stands for nothing but letters that follow the state in some clue."""
        columns: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(len(seen) + 1)]
        columns[0]["   "] = (0.0, None)
        runs = (m.end() - i for m in RUNS.finditer(seen) for i in range(*m.span()))
        for i, run in enumerate(runs):
            here, columns[i] = columns[i], {}
            hides = known and seen[i] in "*#"
            for j, letter, cost in self._edges(seen[i], i, run):
                there = columns[j]
                for last, (score, way) in here.items():
                    price = cost
                    if hides and not letter:
                        price = -2.3  # a skipped wildcard is as dear as a doubled letter
                    elif hides and letter.strip():
                        fitting = self.follow.get(last, ())
                        if letter not in fitting or j > i + 1:  # each stands for a letter of its own
                            continue
                        price += math.log(26 / len(fitting))
                    if letter == " " and last[-1] == " " or not letter:
                        state, now, after = last, score + price, way
                    else:
                        state, now, after = last[1:] + letter, score + price + self._log_p(last, letter), (way, letter)
                    if state not in there or now > there[state][0]:
                        there[state] = (now, after)
        best, way = max(((score + self._log_p(last, " "), way) for last, (score, way) in columns[-1].items()), key=lambda x: x[0])
        letters = []
        while way:
            way, letter = way
            letters.append(letter)
        return best, "".join(reversed(letters)).strip()

    def _may_hide(self, seen: str) -> bool:
        """Whether some clue can be read at the start of ``seen``, symbol by symbol, repetitions and separators skipped."""
        alive, before = {""}, ""
        for c in seen:
            stay = alive if c == before or c in SEPARATORS else ()
            meant = LETTERS if c in "*#" else c if c in LETTERS else LOOKALIKES.get(c, "")
            alive = {*stay, *(a + letter for a in alive for letter in self.ahead.get(a, ()) if letter in meant)}
            if not alive or any(a in self.clues for a in alive):
                return bool(alive)
            before = c
        return False

    def hidden(self, seen: str) -> str | None:
        """The second reading: one word that begins with a clue and is likelier than a string without sense."""
        wild = len(WILD.findall(seen))
        shown = sum(c not in SEPARATORS and c not in "*#" for c in seen)
        if not self.clues or wild > 2 * shown or not self._may_hide(seen):
            return None
        score, word = self._likeliest(GAPS.sub(r"\1", seen), known=True)
        symbols = shown + wild
        return word if self.marks(word) and " " not in word and score > -symbols * math.log(SYMBOLS) else None

    def marks(self, word: str) -> list[int]:
        """The clues that the word begins with."""
        return [self.clues[word[:n]] for n in self.lengths if word[:n] in self.clues and n <= len(word)]

    def token(self, token: str) -> tuple[tuple[str, ...], tuple[int, ...]]:
        """The words of one white-space-delimited, lower-case token, and their clues."""
        if (found := self.seen.get(token)) is None:
            if len(self.seen) >= self.CACHE:
                self.seen.clear()
            words = tuple(self._words(token))
            self.seen[token] = found = (words, tuple(i for w in words for i in self.marks(w)))
        return found

    def _words(self, token: str) -> list[str]:
        core = token.strip(EDGES)
        if core.isalpha() and core == token.strip(EDGES + "$@"):
            return [self._plain(core)]
        words = []
        for piece in SPLIT.split(core):
            found = self._pieces(piece)
            part_of_number = piece.isdigit() and piece != core
            if not (piece.isalpha() or part_of_number or any(map(self.marks, found))) and (word := self.hidden(piece)):
                found = [word]
            words += found
        return words

    def _pieces(self, piece: str) -> list[str]:
        words = []
        for part in NUMBERS.split(piece):
            parts = [p for p in JOINTS.split(part) if p]
            if len(parts) < 2:
                words += self._part(part)
                continue
            apart = [word for p in parts for word in self._part(p)]
            shown = sum(len(self.marks(word)) for word in apart)
            if shown and len(min(parts, key=len)) > 1:
                words += apart
                continue
            joined = self._part(part)
            better = sum(len(self.marks(word)) for word in joined) > shown or (not shown and len(min(parts, key=len)) == 1)
            words += joined if better else apart
        return words

    def _part(self, part: str) -> list[str]:
        if re.search(r"[$@]{3,}", part):
            part = part.strip("$@")
        if part.isalpha():
            return [self._plain(part)]
        return self.decode(part).split() if len(part) > 2 and any(c.isalpha() for c in part) else []

    def _plain(self, word: str) -> str:
        """A word of letters is read otherwise only if a repeated letter hides a clue or stands three times."""
        if not word.isascii() or not DOUBLE.search(word) or self.marks(word):
            return word
        if not self.clues and not TRIPLE.search(word):
            return word
        read = self.decode(word)
        return read if TRIPLE.search(word) or self.marks(read) else word

    def _apart(self, run: str) -> list[str]:
        """The words of a run of single symbols."""
        words = [word for m in SPACED.finditer(run) for word in self.decode(m.group()).split()]
        if any(map(self.marks, words)) or not (word := self.hidden(run)):
            return words
        return [word]

    def words(self, text: str) -> Counter:
        """Words of the restored text with their numbers."""
        low, found = text.lower(), Counter()
        for token, n in Counter(low.split()).items():
            for word in self.token(token)[0]:
                found[word] += n
        for run in APART.finditer(low):
            found.update(self._apart(run.group()))
        return found

    def count_clues(self, text: str) -> Counter:
        """Clues of the restored text with their numbers. Only tokens and runs with a place from which a clue may be read are restored."""
        low, found = text.lower(), Counter()
        end = 0
        for place in self.places.finditer(low) if self.places else ():
            if (start := place.start()) < end:
                continue
            after = SPACE.search(low, start)
            while start > end and not low[start - 1].isspace():
                start -= 1
            end = after.start() if after else len(low)
            for clue in self.token(low[start:end])[1]:
                found[clue] += 1
        for run in APART.finditer(low) if end else ():
            if self.places.search(run.group()):
                for word in self._apart(run.group()):
                    found.update(self.marks(word))
        return found

    def restore(self, text: str) -> str:
        """The whole text with decoded tokens and spaced runs put in place, lower case; white space becomes one space."""
        low = APART.sub(lambda m: " ".join(self._apart(m.group())) or m.group(), text.lower())
        return " ".join(w for token in low.split() for w in self.token(token)[0])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, toxic)`` of at most ``rows`` labelled rows that are not held out, less likely copies: of texts of one label and one least shingle the one whose
    id has the smallest hash stays, whatever the order of rows. Texts of fewer than three words are copies only of equal ones."""
    usable = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL AND crc32(cast(doc_id as string)) % 3 != 1").selectExpr("doc_id sample_id", "toxic")
    chosen = usable.orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows)
    found = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("sample_id"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for text in batch.column("text"):
                words = (text.as_py() or "").lower().split()
                grams = [" ".join(g) for g in zip(words, words[1:], words[2:])] or [" ".join(words)]
                least.append(min(map(xxhash.xxh64_intdigest, grams)) >> 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("toxic"), pa.array(least, pa.int64())], ["doc_id", "text", "toxic", "sketch"])

    told = found.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(sketch, "doc_id long, text string, toxic int, sketch long")
    first = Window.partitionBy("sketch", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return told.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("text", "toxic")


def _wilson(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    z, n = 3.0, np.maximum(n, 1e-9)
    p = hits / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what is made of a row here is far larger than the row."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def _prefix_rows(sample: DataFrame, counts: np.ndarray, only: frozenset | None = None) -> DataFrame:
    """The sample's rows as ``(found map<string, int>, toxic)``: prefixes with their numbers, up to ``LEVELS``."""
    restorer = Restorer(counts, [])

    def prefixes(text: str) -> dict[str, int]:
        found: Counter = Counter()
        for word, n in restorer.words(text).items():
            for k in PREFIXES:
                if k > len(word):
                    break
                if only is None or word[:k] in only:
                    found[word[:k]] += n
        return {p: min(n, LEVELS) for p, n in found.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [prefixes(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([[*f.items()] for f in found], pa.map_(pa.string(), pa.int32())), batch.column("toxic")], ["found", "toxic"])

    return sample.mapInArrow(scan, "found map<string,int>, toxic int")


def learn_clues(sample: DataFrame, counts: np.ndarray) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Prefixes; clues as (prefix's index, least number); the weights of the logistic model of (1, clues). The model is fitted on the clues as a
    restorer that knows them finds them, which is how texts are scored."""
    in_toxic = _prefix_rows(sample.where("toxic = 1"), counts).select(F.explode("found").alias("prefix", "n")).groupBy("prefix").count()
    only = frozenset(in_toxic.where(F.col("count") >= LEAST_TEXTS).select("prefix").toArrow().column("prefix").to_pylist())
    rows = materialize(_prefix_rows(sample, counts, only), "prefixes")
    level = F.explode(F.sequence(F.lit(1), F.col("n"))).alias("level")
    spread = rows.select(F.explode("found").alias("prefix", "n"), "toxic").select("prefix", level, "toxic")
    table = spread.groupBy("prefix", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits")).where(f"hits >= {LEAST_TEXTS} AND hits >= {LEAST_SHARE} * n")
    candidates = sorted((r["prefix"], r["level"]) for r in table.select("prefix", "level").collect())
    at: dict[str, list[tuple[int, int]]] = {}
    for i, (prefix, least) in enumerate(candidates):
        at.setdefault(prefix, []).append((i, least))

    def fire(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            bits = np.zeros((len(batch), len(candidates)), bool)
            for r, found in enumerate(batch.column("found")):
                bits[r, [i for prefix, n in found.as_py() for i, least in at.get(prefix, ()) if n >= least]] = True
            packed = [row.tobytes() for row in np.packbits(bits, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("toxic")], ["fired", "toxic"])

    held = rows.mapInArrow(fire, "fired binary, toxic int").toArrow()  # at most SAMPLE_ROWS rows of a bit a candidate
    toxic = held.column("toxic").to_numpy().astype(float)
    by_row = np.frombuffer(b"".join(held.column("fired").to_pylist()), np.uint8).reshape(len(toxic), -(-len(candidates) // 8))
    blocks = [np.packbits(np.unpackbits(by_row[:, k : k + 128], axis=1).T, axis=1) for k in range(0, by_row.shape[1], 128)]
    prefixes, clues = _choose(candidates, np.concatenate([*blocks, np.zeros((0, -(-len(toxic) // 8)), np.uint8)])[: len(candidates)], toxic)
    marks, toxic = _clue_marks(sample, counts, prefixes, clues)
    return prefixes, clues, _fit(marks, toxic)


def _by_prefix(clues: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    at: dict[int, list[tuple[int, int]]] = {}
    for k, (prefix, least) in enumerate(clues):
        at.setdefault(prefix, []).append((k, least))
    return at


def _fired(restorer: Restorer, at: dict[int, list[tuple[int, int]]], text: str) -> list[int]:
    return sorted(k for prefix, n in restorer.count_clues(text).items() for k, least in at[prefix] if n >= least)


def _clue_marks(sample: DataFrame, counts: np.ndarray, prefixes: list[str], clues: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which clues fire in which row of the sample, and the rows' classes."""
    at = _by_prefix(clues)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(counts, prefixes)
        for batch in batches:
            marks = np.zeros((len(batch), len(clues)), bool)
            for r, text in enumerate(batch.column("text")):
                marks[r, _fired(restorer, at, text.as_py() or "")] = True
            packed = [row.tobytes() for row in np.packbits(marks, axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column("toxic")], ["fired", "toxic"])

    held = sample.mapInArrow(scan, "fired binary, toxic int").toArrow()  # at most SAMPLE_ROWS rows of a bit a clue
    toxic = held.column("toxic").to_numpy().astype(float)
    packed = np.frombuffer(b"".join(held.column("fired").to_pylist()), np.uint8).reshape(len(toxic), -(-len(clues) // 8))
    return np.unpackbits(packed, axis=1, count=len(clues)), toxic


def _choose(candidates: list[tuple[str, int]], member: np.ndarray, toxic: np.ndarray) -> tuple[list[str], list[tuple[int, int]]]:
    """``member``: a row a candidate, of packed bits: the sample's rows that it marks."""
    is_toxic = np.packbits(toxic > 0)
    size = lambda rows: np.bitwise_count(rows).sum(axis=-1, dtype=np.int64)
    bound = _wilson(size(member & is_toxic).astype(float), size(member)) if len(candidates) else np.zeros(0)
    open_rows, taken, rows = np.full(member.shape[1], 255, np.uint8), [], np.empty((64, member.shape[1]), np.uint8)
    for best in sorted(np.flatnonzero(bound >= LEAST_SHARE), key=lambda i: (-bound[i], -len(candidates[i][0]), candidates[i])):
        if (~(member[best] & ~rows[: len(taken)]).any(axis=1)).any():
            continue  # says nothing that one taken clue does not say
        new = member[best] & open_rows
        if bound[best] >= SURE_SHARE or size(new & is_toxic) >= max(2.0, LEAST_SHARE * size(new)):
            if len(taken) == len(rows):
                rows = np.concatenate([rows, np.empty_like(rows)])
            rows[len(taken)] = member[best]
            taken.append(best)
            open_rows &= ~member[best]
    prefixes = sorted({candidates[i][0] for i in taken})
    place = {prefix: i for i, prefix in enumerate(prefixes)}
    clues = [(place[candidates[i][0]], candidates[i][1]) for i in taken]
    return prefixes, clues


def _fit(marks: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression on (1, marks) by Newton steps, with a small ridge; rows alike in marks and class count as one with a weight."""
    packed = np.packbits(np.concatenate([marks, (y > 0)[:, None]], axis=1), axis=1)
    _, first, n = np.unique(packed, axis=0, return_index=True, return_counts=True)
    x, y = np.concatenate([np.ones((len(first), 1)), marks[first]], axis=1), y[first]
    w, ridge = np.zeros(x.shape[1]), 0.1 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (n * (p - y)) + ridge @ w)
    return w


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_clues, text_hash)``: one row a row of ``docs``; the hash is of the text, null as empty."""
    counts = count_characters(docs)
    prefixes, clues, weights = learn_clues(materialize(labelled_sample(docs, labels, sample_rows), "sample"), counts)
    at = _by_prefix(clues)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        restorer = Restorer(counts, prefixes)
        for batch in batches:
            logits, n_clues = [], []
            for text in batch.column("text"):
                fired = _fired(restorer, at, text.as_py() or "")
                logits.append(weights[0] + weights[1:][fired].sum())
                n_clues.append(len(fired))
            p = 1 / (1 + np.exp(-np.array(logits)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array(n_clues, pa.int64()), batch.column("text_hash")], ["doc_id", "score", "n_clues", "text_hash"])

    scored = docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(coalesce(text, '')) text_hash").mapInArrow(scan, "doc_id long, score double, n_clues long, text_hash long")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clues", "text_hash")


def query(spark, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
