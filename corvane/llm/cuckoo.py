"""A cuckoo filter over fixed-size digests, and one bucket of the index of live digests that it guards."""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 200
DIGEST = 32


class CuckooFilter:
    """Four slots of 16 bits a bucket, partial-key hashing; fingerprint 0 marks an empty slot.

    Digests are uniform bytes, so their own bytes serve as hashes.
    """

    def __init__(self, capacity: int):
        need = max(1, int(capacity / (SLOTS * 0.9)) + 1)
        self.n_buckets = 1 << (need - 1).bit_length()
        self.table = [0] * (self.n_buckets * SLOTS)
        self._turn = 0

    @classmethod
    def load(cls, stored: bytes) -> CuckooFilter:
        made = cls(1)
        made.table = np.frombuffer(stored, "<u2").tolist()
        made.n_buckets = len(made.table) // SLOTS
        return made

    def stored(self) -> bytes:
        return np.array(self.table, "<u2").tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        fp = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & (self.n_buckets - 1)
        return fp, first, self._other(first, fp)

    def _other(self, bucket: int, fp: int) -> int:
        return (bucket ^ (fp * 0x5BD1E995)) & (self.n_buckets - 1)

    def _put(self, bucket: int, fp: int) -> bool:
        table, at = self.table, bucket * SLOTS
        for slot in range(at, at + SLOTS):
            if not table[slot]:
                table[slot] = fp
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False when the filter overflowed; the caller then rebuilds a larger one from its stored keys."""
        fp, first, second = self._places(digest)
        if self._put(first, fp) or self._put(second, fp):
            return True
        bucket = second
        for _ in range(MAX_KICKS):
            self._turn = (self._turn + 1) % SLOTS
            slot = bucket * SLOTS + self._turn
            fp, self.table[slot] = self.table[slot], fp
            bucket = self._other(bucket, fp)
            if self._put(bucket, fp):
                return True
        return False

    def contains(self, digest: bytes) -> bool:
        fp, first, second = self._places(digest)
        table = self.table
        return fp in table[first * SLOTS : first * SLOTS + SLOTS] or fp in table[second * SLOTS : second * SLOTS + SLOTS]

    def delete(self, digest: bytes) -> bool:
        fp, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.table[slot] == fp:
                    self.table[slot] = 0
                    return True
        return False


class DigestIndex:
    """A bucket's filter in front of its stored content, the live digests sorted, each with its keep_id and number of copies.

    The filter decides alone that a digest is new: such a digest joins the content without a look at it. Only hits are looked up there,
    all together; those that the content does not know were false ones and join it too. When the filter overflows, it doubles and is
    filled again from the stored keys.
    """

    def __init__(self, capacity: int = 64):
        self.filter = CuckooFilter(capacity)
        self.digests = np.zeros(0, f"V{DIGEST}")
        self.ids, self.known, self.copies = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.resizes = self.looked_up = self.false_hits = 0

    @classmethod
    def load(cls, stored: bytes, digests: list[bytes], ids: list[int | None], copies: list[int]) -> DigestIndex:
        made = cls(1)
        made.filter = CuckooFilter.load(stored)
        made._join(_array(digests), ids, copies)
        return made

    def _join(self, digests: np.ndarray, ids: list[int | None], copies: list[int]) -> None:
        every = np.concatenate([self.digests, digests])
        order = np.argsort(_sortable(every), kind="stable")
        known = np.array([i is not None for i in ids], bool)
        self.digests = every[order]
        self.ids = np.concatenate([self.ids, np.array([i or 0 for i in ids], np.int64)])[order]
        self.known = np.concatenate([self.known, known])[order]
        self.copies = np.concatenate([self.copies, np.array(copies, np.int64)])[order]

    def places(self, digests: list[bytes]) -> np.ndarray:
        """Where the content holds each digest; -1 where it does not."""
        wanted, held = _sortable(_array(digests)), _sortable(self.digests)
        if not len(held):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
        return np.where(held[at] == wanted, at, -1)

    def __contains__(self, digest: bytes) -> bool:
        return self.filter.contains(digest) and self.places([digest])[0] >= 0

    def _admit(self, digest: bytes, others: list[bytes]) -> None:
        if self.filter.insert(digest):
            return
        size = self.filter.n_buckets * SLOTS
        while True:
            size *= 2
            self.resizes += 1
            grown = CuckooFilter(int(size * 0.85))
            if all(grown.insert(key) for key in self.digests.tolist()) and all(map(grown.insert, [*others, digest])):
                self.filter = grown
                return

    def insert(self, digests: list[bytes], ids: list[int | None], copies: list[int]) -> int:
        """How many digests were not live before. The smallest id stays; null ids never win over others."""
        new, hits = [], []
        fresh: list[bytes] = []
        for i, digest in enumerate(digests):
            if self.filter.contains(digest):
                hits.append(i)
            else:
                self._admit(digest, fresh)
                new.append(i)
                fresh.append(digest)
        self._join(_array(fresh), [ids[i] for i in new], [copies[i] for i in new])
        self.looked_up += len(hits)
        at = self.places([digests[i] for i in hits])
        missing = [i for i, place in zip(hits, at) if place < 0]
        self._merge(at, [ids[i] for i in hits], [copies[i] for i in hits])
        if missing:
            folded: dict[bytes, list] = {}
            for i in missing:
                entry = folded.setdefault(digests[i], [None, 0])
                entry[0] = ids[i] if entry[0] is None else entry[0] if ids[i] is None else min(entry[0], ids[i])
                entry[1] += copies[i]
            self.false_hits += len(folded)
            for k, digest in enumerate(folded):
                self._admit(digest, list(folded)[:k])
            self._join(_array(list(folded)), [e[0] for e in folded.values()], [e[1] for e in folded.values()])
            return len(new) + len(folded)
        return len(new)

    def _merge(self, at: np.ndarray, ids: list[int | None], copies: list[int]) -> None:
        for place, own, n in zip(at.tolist(), ids, copies):
            if place < 0:
                continue
            self.copies[place] += n
            if own is not None and (not self.known[place] or own < self.ids[place]):
                self.ids[place], self.known[place] = own, True

    def delete(self, digests: list[bytes], copies: list[int]) -> int:
        """Take away copies of distinct digests; how many are no longer live. ``keep_id`` names a digest until then."""
        hits = [i for i, digest in enumerate(digests) if self.filter.contains(digest)]
        self.looked_up += len(hits)
        at = self.places([digests[i] for i in hits])
        for i, place in zip(hits, at.tolist()):
            if place >= 0:
                self.copies[place] -= copies[i]
        dead = self.copies <= 0
        for digest in self.digests[dead].tolist():
            self.filter.delete(digest)
        self.digests, self.ids, self.known, self.copies = self.digests[~dead], self.ids[~dead], self.known[~dead], self.copies[~dead]
        return int(dead.sum())

    def rows(self) -> tuple[list[bytes], list[int | None], list[int]]:
        """Digests, keep_ids and copies."""
        return self.digests.tolist(), [i if k else None for i, k in zip(self.ids.tolist(), self.known.tolist())], self.copies.tolist()


def _array(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), f"V{DIGEST}")


def _sortable(digests: np.ndarray) -> np.ndarray:
    """Digests as pairs of numbers would sort slowly; as strings they sort by bytes. A last byte keeps zeros at their ends."""
    padded = np.ones((len(digests), DIGEST + 1), np.uint8)
    padded[:, :DIGEST] = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, DIGEST)
    return padded.reshape(-1).view(f"S{DIGEST + 1}")
