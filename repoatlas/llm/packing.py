"""Packing of documents into sequences by minimum bin slack."""

import zlib

from pyspark.sql import DataFrame

from repoatlas.llm.common import arrow_map, text_encoder

ROOM = 4096
# Remainders that a task holds at most before it fills windows with them.
POOL = 2048
# A window with this slack or less is closed as it is; at the end of a task, pieces of
# worse windows are cut anew so that nothing but powers of two remain.
SLACK = ROOM // 256


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths whose sum comes closest to ``room`` from below.

    Subset sums are the bits of one integer. Each length enters with its copies in powers
    of two; the states before each entry give the counts on the way back.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    target, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + copies
            target -= length * copies
    return used


class Packer:
    """Fills sequences with pieces (doc_id, start, ids, doc_tokens) of one task."""

    def __init__(self, room: int, pool: int, first_sequence: int, width: int):
        self.room, self.pool, self.width = room, pool, width
        self.sequence = first_sequence
        self.waiting: dict[int, list] = {}
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: bytes):
        total = len(ids) // self.width
        span = self.room * self.width
        whole = total // self.room
        for n in range(whole):
            self._put([(doc_id, n * self.room, ids[n * span : (n + 1) * span], total)])
        if total % self.room:
            piece = (doc_id, whole * self.room, ids[whole * span :], total)
            self.waiting.setdefault(total % self.room, []).append(piece)
            self.held += 1
        if self.held >= self.pool:
            while self.held > self.pool // 2:
                self._put(self._window())

    def _window(self) -> list:
        """The longest piece that waits, and what fills its window best."""
        longest = max(self.waiting)
        pieces = [self._take(longest)]
        counts = {length: len(rows) for length, rows in self.waiting.items()}
        for length, copies in best_fill(counts, self.room - longest).items():
            pieces += [self._take(length) for _ in range(copies)]
        return pieces

    def _take(self, length: int):
        rows = self.waiting[length]
        piece = rows.pop()
        if not rows:
            del self.waiting[length]
        self.held -= 1
        return piece

    def _put(self, pieces: list):
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, ids, total, self.sequence, at))
            at += len(ids) // self.width
        self.sequence += 1

    def finish(self):
        """Closes all windows. Pieces of those that stay far from full are cut: into full
        windows, and the last into sequences of powers of two, which need no padding."""
        loose = []
        while self.held:
            pieces = self._window()
            if self.room - sum(len(p[2]) for p in pieces) // self.width <= SLACK:
                self._put(pieces)
            else:
                loose += pieces
        left = sum(len(p[2]) for p in loose) // self.width
        while left:
            size = self.room if left >= self.room else 1 << (left.bit_length() - 1)
            pieces, need = [], size
            while need:
                doc_id, start, ids, total = loose.pop()
                cut = min(need, len(ids) // self.width)
                pieces.append((doc_id, start, ids[: cut * self.width], total))
                if cut * self.width < len(ids):
                    loose.append((doc_id, start + cut, ids[cut * self.width :], total))
                need -= cut
            self._put(pieces)
            left -= size


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


def pack(
    docs: DataFrame, path: str, folds: bool, end_id: int, room: int = ROOM, with_ids: bool = True
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``room`` ids.

    Long documents fill windows of their own; what remains of each document waits in a
    bounded pool of its task, from which windows are filled. Nothing is shuffled and no
    group is gathered, so a hot source or copies change nothing. A sequence number is the
    task's number and a count within it. Null text counts as empty: such a document is
    its end id. Null doc_ids and repeated rows are packed like others, each row for
    itself. Other columns are not read. ``with_ids`` adds the piece's ids (binary,
    little-endian unsigned 32 bit).
    """

    def run(batches):
        from pyspark import TaskContext

        encoder = text_encoder(path, folds, 4)
        end = end_id.to_bytes(4, "little")
        packer = Packer(room, POOL, TaskContext.get().partitionId() << 40, 4)

        def rows():
            out, packer.out = packer.out, []
            columns = {
                "doc_id": [r[0] for r in out],
                "start": [r[1] for r in out],
                "length": [len(r[2]) // 4 for r in out],
                "ids_crc32": [zlib.crc32(r[2]) for r in out],
                "doc_tokens": [r[3] for r in out],
                "sequence_id": [r[4] for r in out],
                "offset": [r[5] for r in out],
            }
            return columns | ({"ids": [r[2] for r in out]} if with_ids else {})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                packer.add(doc_id, encoder(text or "") + end)
                if len(packer.out) >= 4096:
                    yield rows()
        packer.finish()
        yield rows()

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA + ", ids binary" * with_ids)
