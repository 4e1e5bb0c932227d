"""N-best segmentation into the pieces of a SentencePiece vocabulary, and its inverse.

Text is written as SentencePiece does (a leading space, spaces as U+2581) and every way to cover it with pieces is a path of a lattice. A
forward Viterbi pass gives the best score of every prefix; A-star then walks backwards from the end with these
scores as heuristics. They are exact, so the paths leave the agenda in order and the first n are the n best.

One order holds everywhere: higher score, then fewer pieces, then the smaller ids, read from the end of the text. It is additive but for its last part,
and that part is what a backward search sees first, so the search needs no look ahead to keep it.

No piece holds anything before a space mark but other space marks, so the lattice is a chain of one lattice a word (a long word: a stretch between
places that no piece spans). Such a unit is searched once a worker:

- All new units of a batch run in lockstep, one numpy step a position: the forward pass over a trie, then A-star to its first
  path. The best entry then left on the agenda is, its heuristic being exact, the score of the second path.
- A text's n best differ from its best in at most n - 1 units, and only in those whose second path loses least. These units' searches go on to
  n paths, and the least changes are combined.

Scores are the model's own. A character without a piece costs ``penalty`` below the lowest piece's score and becomes its
UTF-8 bytes' pieces. Vocabularies of either kind are read; nothing is trained.

Defined results: null and empty texts have no pieces and one segmentation of score 0; fewer than n segmentations exist
for short texts and the arrays are shorter then; very long texts are whole, also if they are one word; repeated rows get equal results; an empty table
gives no rows; other columns are ignored. U+2581 in a text decodes to a space, as in the library.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import read_table
from .words import default_path

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
PENALTY = 10.0
RUN_SCORE = -1e8  # pieces below this are runs of spaces that the model never prefers
INF = float("inf")
CODES = 1 << 21  # more than there are characters
DENSE = 128  # the trie's commonest characters have a column each
WIDE = 64  # longer units are searched one by one
CHUNK = 6_000  # units in lockstep
GROUP = 2_000_000  # characters of texts that are summed up together
Path = tuple[float, tuple[int, ...]]
Change = tuple[int, np.ndarray]  # the place of a unit in a text, and the ids that stand there


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.held, self.size = np.empty(1024, kind), 0

    def extend(self, values) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.empty(max(need, 2 * len(self.held)) - self.size, self.held.dtype)])
        self.held[self.size : need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self.held[: self.size]


def _slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all slices, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """A model, and the units that have been searched."""

    CACHE = 900_000

    def __init__(self, path: str, n: int, penalty: float = PENALTY):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.n = n
        self.pieces: dict[str, tuple[float, int]] = {}
        self.bytes = [0] * 256
        raw = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type in (1, 4):
                self.pieces[p.piece] = (p.score, i)
            elif p.type == 6:
                self.bytes[int(p.piece[3:5], 16)], raw[i] = i, bytes([int(p.piece[3:5], 16)])
        self.raw, self.raw_length = np.frombuffer(b"".join(raw), np.uint8), np.array([*map(len, raw)])
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.scores = np.array([p.score for p in model.pieces])
        self.n_ids = len(raw)
        self.weight, self.last = np.ones(self.n_ids, np.int32), np.arange(self.n_ids)  # how many ids an edge has, and its last one
        self.spelt: list[list[int]] = []  # the ids of edges over characters without a piece; these edges are numbered from n_ids
        self.longest = max(map(len, self.pieces))
        self.spanned = frozenset(p[k : k + 2] for p in self.pieces for k in range(len(p) - 1))
        self.unknown = min(s for s, _ in self.pieces.values() if s > RUN_SCORE) - penalty
        self._build_trie()
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}  # a unit less its leading mark
        self.inner: dict[str, int] = {}  # units that begin within a word
        self.units: list[str] = []
        self.score, self.loss, self.count, self.start = Grown(np.float64), Grown(np.float64), Grown(np.int64), Grown(np.int64)
        self.pool = Grown(np.uint32)
        self.found: dict[int, list[tuple[float, int, int, np.ndarray]]] = {}

    def _build_trie(self) -> None:
        nodes: dict[str, int] = {"": 1}  # node 0 is the end of all that is no prefix
        for piece in self.pieces:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes) + 1)
        used: dict[str, int] = {}
        for prefix in nodes:
            if prefix:
                used[prefix[-1]] = used.get(prefix[-1], 0) + 1
        letters = sorted(used, key=lambda c: -used[c])
        self.code = np.zeros(0x110000, np.int32)
        self.code[[*map(ord, letters)]] = np.arange(1, len(letters) + 1)
        self.single = np.zeros(len(letters) + 1, bool)
        self.single[[self.code[ord(p)] for p in self.pieces if len(p) == 1]] = True
        self.next = np.zeros((len(nodes) + 1, DENSE), np.int32)
        self.piece_at = np.full(len(nodes) + 1, -1, np.int32)
        rare = {}
        for prefix, node in nodes.items():
            if prefix:
                parent, code = nodes[prefix[:-1]], int(self.code[ord(prefix[-1])])
                if code < DENSE:
                    self.next[parent, code] = node
                else:
                    rare[parent * CODES + code] = node
            if prefix in self.pieces:
                self.piece_at[node] = self.pieces[prefix][1]
        self.rare = np.array(sorted(rare), np.int64)
        self.rare_next = np.array([rare[k] for k in sorted(rare)] + [0], np.int32)
        self.is_prefix = frozenset(nodes)

    def _learn(self, characters: np.ndarray) -> None:
        """Make an edge of its bytes' pieces for each character (a code point) that has no piece, and put it into the trie."""
        spelt = [[self.bytes[b] for b in chr(c).encode()] for c in characters.tolist()]
        edges = np.arange(len(spelt)) + self.n_ids + len(self.spelt)
        self.spelt += spelt
        self.scores = np.append(self.scores, np.full(len(spelt), self.unknown))
        self.weight = np.append(self.weight, np.array([*map(len, spelt)], np.int32))
        self.last = np.append(self.last, [s[-1] for s in spelt])
        new = characters[self.code[characters] == 0]
        self.code[new] = np.arange(len(self.single), len(self.single) + len(new))
        self.single = np.append(self.single, np.zeros(len(new), bool))
        codes = self.code[characters]
        self.single[codes] = True
        node = self._step(np.ones(len(codes), np.int32), codes)
        fresh = node == 0
        node[fresh] = np.arange(len(self.piece_at), len(self.piece_at) + fresh.sum())
        self.next = np.concatenate([self.next, np.zeros((int(fresh.sum()), DENSE), np.int32)])
        self.piece_at = np.append(self.piece_at, np.full(int(fresh.sum()), -1, np.int32))
        self.piece_at[node] = edges
        common = fresh & (codes < DENSE)
        self.next[1, codes[common]] = node[common]  # the root is node 1
        rare = fresh & ~common
        keys = np.append(self.rare, CODES + codes[rare].astype(np.int64))
        order = np.argsort(keys)
        self.rare, self.rare_next = keys[order], np.append(np.append(self.rare_next[:-1], node[rare])[order], np.int32(0))

    def _step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        common = code < DENSE
        if common.all():
            return self.next[node, code]
        found = self.next[node, np.where(common, code, 0)]
        key = node[~common].astype(np.int64) * CODES + code[~common]
        at = np.searchsorted(self.rare, key)
        hit = self.rare[np.minimum(at, len(self.rare) - 1)] == key if len(self.rare) else np.zeros(len(key), bool)
        found[~common] = np.where(hit, self.rare_next[at], 0)
        return found

    # One unit at a time

    def _edges(self, unit: str) -> Iterator[tuple[int, int, float, bytes]]:
        """The lattice's edges by start: from, to, score, ids from the last to the first as big-endian 32-bit bytes."""
        for i in range(len(unit)):
            known = False
            for j in range(i + 1, min(i + self.longest, len(unit)) + 1):
                if (part := unit[i:j]) not in self.is_prefix:
                    break
                if part in self.pieces:
                    score, piece = self.pieces[part]
                    yield i, j, score, piece.to_bytes(4, "big")
                    known = known or j == i + 1
            if not known:
                yield i, i + 1, self.unknown, b"".join([self.bytes[b].to_bytes(4, "big") for b in reversed(unit[i].encode())])

    def search(self, unit: str, n: int | None = None, most: float = INF) -> list[Path]:
        """The n best (score, ids) of a unit, best first, without those that lose more than ``most``. Of the agenda only as many entries stay as
        paths are wanted: each ends in a path of its own."""
        size, wanted = len(unit), self.n if n is None else n
        arrivals: list[list[tuple[int, float, bytes]]] = [[] for _ in range(size + 1)]
        best: list[tuple[float, int]] = [(0.0, 0)] + [(-INF, 0)] * size  # score and, the more the worse, minus the pieces
        for i, j, score, ids in self._edges(unit):
            arrivals[j].append((i, score, ids))
            best[j] = max(best[j], (best[i][0] + score, best[i][1] - len(ids) // 4))
        agenda, paths, worst = [(-best[size][0], -best[size][1], b"", size, 0.0)], [], most - best[size][0] + 1e-9 * abs(best[size][0])  # the margin is for rounding
        while agenda and len(paths) < wanted:
            _, _, ids, at, score = agenda.pop(0)
            if at == 0:
                paths.append((score, tuple(np.frombuffer(ids, ">u4")[::-1].tolist())))
                continue
            for i, own, piece in arrivals[at]:
                total = -(score + own + best[i][0])
                if total > worst or (len(agenda) == wanted - len(paths) and total > agenda[-1][0]):
                    continue
                longer = ids + piece
                bisect.insort(agenda, (total, len(longer) // 4 - best[i][1], longer, i, score + own))
                del agenda[wanted - len(paths) :]
        return paths

    # All new units at once

    def _add(self, units: list[str]) -> None:
        """Search new units to their first path and the second's score."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        if len(unknown := np.unique(points[~self.single[self.code[points]]])):
            self._learn(unknown)
        codes = self.code[points]
        ends = np.cumsum(lengths)
        plain = lengths <= WIDE
        order = np.argsort(lengths, kind="stable")
        order = order[plain[order]]
        score, loss, ids = np.empty(len(units)), np.full(len(units), INF), [None] * len(units)
        count, start, added, base = np.empty(len(units), np.int64), np.empty(len(units), np.int64), [], self.pool.size
        for k in range(0, len(order), CHUNK):
            chunk = order[k : k + CHUNK]
            score[chunk], loss[chunk], count[chunk], own = self._lockstep(codes, (ends - lengths)[chunk], lengths[chunk])
            start[chunk] = base + np.cumsum(count[chunk]) - count[chunk]
            base += len(own)
            added.append(own)
        for i in np.flatnonzero(~plain):
            (score[i], ids), *others = self.search(units[i], 2)
            loss[i] = score[i] - others[0][0] if others else INF
            count[i], start[i] = len(ids), base
            base += len(ids)
            added.append(np.array(ids, np.uint32))
        self.units += units
        for held, values in ((self.score, score), (self.loss, loss), (self.count, count), (self.start, start)):
            held.extend(values)
        self.pool.extend(np.concatenate(added))

    def _lockstep(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best scores, what the second path loses, numbers of pieces, and the best paths' ids one after the other."""
        n, size = len(lengths), int(lengths.max())
        letters, wide = np.zeros((size, n), np.int32), min(size, self.longest)
        inside = np.arange(size)[:, None] < lengths
        letters[inside] = codes[(starts + np.arange(size)[:, None])[inside]]
        best, pieces = np.full((size + 1, n), -INF), np.zeros((size + 1, n), np.int32)
        best[0] = 0.0
        edge = np.full((size + 1, wide, n), -1, np.int32)  # by end, length - 1 and unit
        for i in range(size):
            at = np.flatnonzero(lengths > i)
            node = np.ones(len(at), np.int32)
            for d in range(min(wide, size - i)):
                node = self._step(node, letters[i + d, at])
                alive = np.flatnonzero(node)
                if len(alive) < len(node):
                    at, node = at[alive], node[alive]
                if not len(at):
                    break
                piece = self.piece_at[node]
                here = np.flatnonzero(piece >= 0)
                if not len(here):
                    continue
                who, piece, j = at[here], piece[here], i + d + 1
                edge[j, d, who] = piece
                total, number, old = best[i, who] + self.scores[piece], pieces[i, who] + self.weight[piece], best[j, who]
                better = (total > old) | ((total == old) & (number < pieces[j, who]))
                who = who[better]
                best[j, who], pieces[j, who] = total[better], number[better]
        score, count, edges = best[lengths, np.arange(n)], pieces[lengths, np.arange(n)].astype(np.int64), np.zeros(n, np.int64)
        at, done, walked, agenda = lengths.copy(), np.zeros(n), [], np.full(n, -INF)
        who, back = np.arange(n), np.arange(1, wide + 1)
        while len(who):
            end = at[who]
            piece = edge[end, :, who]
            known = piece >= 0
            begin = np.where(known, end[:, None] - back, 0)
            total = np.where(known, done[who][:, None] + self.scores[piece] + best[begin, who[:, None]], -INF)
            first = total.max(axis=1, keepdims=True)
            rank = np.where(total == first, (pieces[begin, who[:, None]] + self.weight[piece]).astype(np.int64) << 32 | self.last[piece], np.iinfo(np.int64).max)
            taken, row = rank.argmin(axis=1), np.arange(len(who))
            total[row, taken] = -INF
            agenda[who] = np.maximum(agenda[who], total.max(axis=1))
            done[who] += self.scores[piece[row, taken]]
            at[who] = begin[row, taken]
            edges[who] += 1
            walked.append((who, piece[row, taken]))
            who = who[at[who] > 0]
        ids, first = np.empty(int(edges.sum()), np.int64), np.cumsum(edges) - edges
        for t, (who, piece) in enumerate(walked):
            ids[first[who] + edges[who] - 1 - t] = piece
        if (unknown := ids >= self.n_ids).any():
            lengths = self.weight[ids].astype(np.int64)
            spelt = [i for edge in ids[unknown].tolist() for i in self.spelt[edge - self.n_ids]]
            ids = np.repeat(ids, lengths)
            ids[np.repeat(unknown, lengths)] = spelt
        return score, score - agenda, count, ids

    # Texts

    def _cut(self, word: str) -> list[str]:
        cuts = [0, *[k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.spanned], len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def indices(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts one after the other, and each text's number of them."""
        if len(self.units) > self.CACHE:
            self._forget()
        words: list[list[str]] = []
        for text in texts:
            found = text.split(" ") if text else []
            if SPACE in text or "" in found:
                found = [w[1:] for w in WORDS.findall(mark(text))]
            words.append(found)
        flat = [w for found in words for w in found]
        at = np.fromiter(map(self.index.get, flat, itertools.repeat(-1)), np.int64, len(flat))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        unseen = np.flatnonzero(at < 0)
        if not len(unseen):
            return at, sizes
        unseen_words = [flat[i] for i in unseen.tolist()]
        new, long = [], {}
        for word in dict.fromkeys(unseen_words):
            if len(word) < WIDE or len(parts := self._cut(SPACE + word)) == 1:
                self.index[word] = len(self.units) + len(new)
                new.append(SPACE + word)
                continue
            for k, part in enumerate(parts):
                held, name = (self.inner, part) if k else (self.index, part[1:])
                if name not in held:
                    held[name] = len(self.units) + len(new)
                    new.append(part)
            long[word] = [(self.inner if k else self.index)[part if k else part[1:]] for k, part in enumerate(parts)]
        if new:
            self._add(new)
        if not long:
            at[unseen] = [*map(self.index.__getitem__, unseen_words)]
            return at, sizes
        spread = [[i for w in found for i in long.get(w) or [self.index[w]]] for found in words]
        return np.array([i for units in spread for i in units], np.int64), np.array([*map(len, spread)], np.int64)

    def _paths(self, unit: int, most: float) -> list[tuple[float, int, int, np.ndarray]]:
        """(loss, further pieces, rank of the ids read from the end, ids) of those of a unit's n best that lose no more than ``most``; the
        first is the best. What was found is kept until a text asks for more."""
        bound, found = self.found.get(unit, (-1.0, None))
        if most > bound:
            paths = self.search(self.units[unit], most=most)
            ranks = {ids: r for r, ids in enumerate(sorted((ids for _, ids in paths), key=lambda ids: ids[::-1]))}
            score, first = paths[0]
            found = [(score - s, len(ids) - len(first), ranks[ids] - ranks[first], np.array(ids, np.uint32)) for s, ids in paths]
            self.found[unit] = most, found
        return found

    def _best_changes(self, units: np.ndarray) -> list[tuple[float, int, tuple[Change, ...]]]:
        """(loss, further pieces, changes) of a text's n best, best first. Of a unit that recurs only the n - 1 outermost places matter: of
        equal changes the order takes those nearest to one end."""
        room, whole = self.n - 1, [(0.0, 0, ())]
        if not room or not len(units):
            return whole
        loss = self.loss.all[units]
        most = float(np.partition(loss, room - 1)[room - 1]) if len(loss) > room else INF
        near = np.flatnonzero(loss <= most)
        places: dict[int, list[int]] = {}
        for place, unit in zip(near.tolist(), units[near].tolist()):
            places.setdefault(unit, []).append(place)
        changes = []
        for unit, held in places.items():
            paths = [*enumerate(self._paths(unit, most))][1:]
            for place in held if len(held) <= 2 * room else held[:room] + held[-room:]:
                changes += [(lost, more, rank > 0, place if rank > 0 else -place, k, rank, place, ids) for k, (lost, more, rank, ids) in paths]
        each: dict[int, list] = {}
        for lost, more, _, _, _, rank, place, ids in heapq.nsmallest(room, changes, key=lambda c: c[:5]):
            each.setdefault(place, [(0.0, 0, 0, ())]).append((lost, more, rank, ((place, ids),)))
        best = [(0.0, 0, (), ())]
        for place in sorted(each, reverse=True):
            grown = ((a + b, x + y, (*r, s), c + d) for a, x, r, c in best for b, y, s, d in each[place])
            best = sorted(grown, key=lambda c: c[:3])[: self.n]
        return [(lost, more, made) for lost, more, _, made in best]

    def segmentations(self, units: np.ndarray) -> tuple[np.ndarray, list[tuple[float, int, list]]]:
        """The ids of a text's best segmentation, and of each of the n best, best first: score, number of pieces, and its ids in runs: a slice
        of the best one's, or an array of its own."""
        counts, starts = self.count.all[units], self.start.all[units]
        ids, total = self.pool.all[_slices(starts, counts)], float(self.score.all[units].sum())
        ends, found = np.cumsum(counts), []
        for lost, more, changes in self._best_changes(units):
            runs, free = [], 0
            for place, other in sorted(changes, key=lambda c: c[0]):
                runs += [slice(free, int(ends[place] - counts[place])), other]
                free = int(ends[place])
            found.append((total - lost, len(ids) + more, [*runs, slice(free, len(ids))]))
        return ids, found

    def _bytes(self, ids: np.ndarray) -> np.ndarray:
        """The UTF-8 text of ids."""
        return self.raw[_slices(self.raw_start[ids], self.raw_length[ids])]

    def segment(self, text: str) -> list[Path]:
        """The n best (score, ids) of a whole text."""
        units, _ = self.indices([text])
        ids, found = self.segmentations(units)
        return [(score, tuple(np.concatenate([ids[r] if isinstance(r, slice) else r for r in runs]).tolist())) for score, _, runs in found]

    def decode(self, ids: tuple[int, ...]) -> str:
        """The text of ids, less the leading space that the encoder puts."""
        return self._bytes(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace")[1:]

    def summaries(self, texts: list[str]) -> list[tuple[list[float], list[int], list[int], list[int]]]:
        """Of each text: scores, numbers of pieces, CRC-32 of the ids and CRC-32 of the decoded text, of its n best."""
        units, sizes = self.indices(texts)
        ends, rows = np.cumsum(sizes), []
        for a, b in zip((ends - sizes).tolist(), ends.tolist()):
            ids, found = self.segmentations(units[a:b])
            text, at = self._bytes(ids), np.append(0, np.cumsum(self.raw_length[ids]))
            sums, texts_of = [], []
            for _, _, runs in found:
                crc, again, lead = 0, 0, 1  # the leading space is no part of the text
                for run in runs:
                    own = isinstance(run, slice)
                    crc = zlib.crc32(ids[run] if own else run, crc)
                    part = text[at[run.start] : at[run.stop]] if own else self._bytes(run)
                    again = zlib.crc32(part[lead:], again)
                    lead = 0 if len(part) else lead
                sums.append(crc)
                texts_of.append(again)
            rows.append(([score for score, _, _ in found], [count for _, count, _ in found], sums, texts_of))
        return rows


def mark(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@functools.cache
def vocabulary(path: str, n: int) -> Vocabulary:
    """One a Python worker."""
    return Vocabulary(path, n)


def groups_of(texts: Iterator[str], size: int = GROUP) -> Iterator[list[str]]:
    """Runs of texts of about this many characters; a longer text is a run of its own."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


SUMMARY = "doc_id long, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, decoded_crc32 array<long>"


def best_segmentations(docs: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """``SUMMARY``: of every whole text, for its n best segmentations, best first: score, number of pieces, CRC-32 of the
    little-endian 32-bit ids, and CRC-32 of the UTF-8 text that these ids decode to."""
    path = model or default_path("piece_bpe_32k.model")
    kinds = [pa.list_(t) for t in (pa.float64(), pa.int64(), pa.int64(), pa.int64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = vocabulary(path, n).summaries
        for batch in batches:
            found = [row for texts in groups_of(t.as_py() or "" for t in batch.column("text")) for row in summaries(texts)]
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", "scores", "n_pieces", "ids_crc32", "decoded_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, SUMMARY)


def round_trip(docs: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """``(doc_id, ids array<array<int>>, texts array<string>)``: the n best segmentations, and each decoded again."""
    path = model or default_path("piece_bpe_32k.model")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, n)
        for batch in batches:
            paths = [[list(ids) for _, ids in v.segment(t.as_py() or "")] for t in batch.column("text")]
            texts = [[v.decode(tuple(ids)) for ids in p] for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(paths, pa.list_(pa.list_(pa.int32()))), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "ids", "texts"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, "doc_id long, ids array<array<int>>, texts array<string>")


def query(spark, sf_dir: str) -> DataFrame:
    return best_segmentations(read_table(spark, sf_dir, "documents"))
