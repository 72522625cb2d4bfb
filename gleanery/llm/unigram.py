"""SentencePiece encoding, decoding and token counts under unigram scores.

The best segmentation of a text is the one with the greatest sum of piece scores.
An Aho-Corasick automaton over the pieces reads each byte once; at each position
its output links give all pieces that end there, longest first, and each relaxes
the best score of the position. A piece replaces another only with a greater
score, so of equal ones the piece that starts first stays, the rule of the
public unigram tokenizer. A character that is no piece of its own may be unknown, at the least
score less 10, and is written as its bytes.

With `library` (the default of the functions on tables) sums are the library's own: it
adds in 32 bits, and where the best sum of a start is far from 0 it takes that off all
later ends, which rounds them. After a space mark, whose score is -10^9 in the file used
here, most ends are then equal, and the piece that starts first stays (`▁the`, not `▁t`
`he`). Ids are those of the library's plain encode. Without it sums are exact, and the
segmentation is the first of the library's n-best list. A vocabulary whose mark does not weigh so much, or whose scores
are no whole numbers, is always read with exact sums.

No piece has a space mark after another character, so a text falls apart into
words with their leading marks (and bytes that no piece has), and each distinct
word of a stretch of text is segmented once. Words are read side by side: a step
moves the automata of a whole block of words by a byte. A long word (text without
blanks, packed data) is read in overlapping parts side by side, as a state depends on
no more bytes than the longest piece has; what it matches is then relaxed in order.

Null ids are passed through. Null texts have null ids, decoded texts and counts; empty texts have no pieces.
Repeated rows give repeated results; other columns are ignored. The vocabulary
is a file of fixed size, read by the driver and broadcast.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbytes import KEPT, Texts, column, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
STRETCH = 1 << 19
#: From here on the library sets sums back (its own limit isn't known; 10^5 to 10^8 have the same results on the tables here).
FAR = 1e5
#: Cells of the table that one block of words fills.
_CELLS = 1 << 17
#: Bytes from which a word is read in parts; bytes of it whose matches are held at once; bytes of a part.
_LONG, _SPAN, _PART = 512, 1 << 15, 128
#: Ids that are decoded at once.
_IDS = 1 << 17


@dataclass
class Vocabulary:
    """Pieces that text is matched with; what each id decodes to; ids of bytes; the penalty score of unknown characters."""

    pieces: list[bytes]
    ids: np.ndarray
    scores: np.ndarray
    surface: list[bytes]
    byte_ids: np.ndarray
    unknown: float

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, surface, byte_ids = [], [], np.full(256, m.unk_id(), np.int32)
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_unknown(i):
                surface.append(" ⁇ ".encode())
            elif m.is_control(i) or m.is_unused(i):
                surface.append(b"")
            elif m.is_byte(i):
                surface.append(bytes([int(p[1:-1], 16)]))
                byte_ids[int(p[1:-1], 16)] = i
            else:
                surface.append(p.encode().replace(MARK, b" "))
                normal.append(i)
        scores = np.array([m.get_score(i) for i in normal])
        return cls([m.id_to_piece(i).encode() for i in normal], np.array(normal, np.int32), scores, surface, byte_ids, float(scores.min()) - 10.0)


def _round(x: float) -> float:
    """To 32 bits; whole numbers below 2^24 are exact."""
    return x if -16777216.0 < x < 16777216.0 else float(np.float32(x))


class _Sums:
    """The library's sums of words side by side.

    It goes by start: where the best sum of a start is FAR from 0, that is taken from all sums of later ends, with the
    rounding of 32 bits, and counts as 0. Here ends are relaxed one after another, so an end's sum catches up with what
    was taken off at the starts between two candidates before they are compared.
    """

    def __init__(self, long: int, n: int):
        self.events = np.zeros((long + 1, n), np.int64)  # starts so far at which something was taken off
        self.off = np.zeros((4, n), np.float32)
        self.upto = np.zeros(n, np.int64)

    def begin(self) -> None:
        self.upto[:] = 0

    def catch_up(self, best: np.ndarray, t: int, who: np.ndarray, start: np.ndarray) -> None:
        """Brings best[t] of words `who` to the time of their starts."""
        there = self.events[start, who]
        while True:
            late = self.upto[who] < there
            if not late.any():
                return
            w = who[late]
            best[t, w] -= self.off[self.upto[w], w]
            self.upto[w] += 1

    def finish(self, best: np.ndarray, t: int, starts: np.ndarray) -> None:
        """Brings best[t] up to date and takes it off what follows, in words where t is a start."""
        every = np.arange(best.shape[1])
        self.catch_up(best, t, every, np.full(len(every), t - 1))
        self.events[t] = self.events[t - 1]
        far = np.flatnonzero(starts & (np.abs(best[t]) > FAR) & np.isfinite(best[t]))
        if len(far):
            if self.events[t].max() + 1 >= len(self.off):
                self.off = np.concatenate([self.off, np.zeros_like(self.off)])
            self.off[self.events[t, far], far] = best[t, far]
            self.events[t, far] += 1
            best[t, far] = 0.0


class Automaton:
    """Aho-Corasick over a vocabulary's pieces, as arrays by state."""

    def __init__(self, v: Vocabulary, library: bool = False):
        """`library`: sums are those of the public library's encode, see the module."""
        self.v = v
        used = np.zeros(256, bool)
        used[np.frombuffer(b"".join(v.pieces), np.uint8)] = True
        self.alone = ~used  # bytes that no piece has
        self.kind = np.where(used, np.cumsum(used), 0).astype(np.intp)
        kinds = int(self.kind.max()) + 1
        child: list[dict[int, int]] = [{}]
        at = np.empty(len(v.pieces), np.int64)
        kind = self.kind.tolist()
        for i, p in enumerate(v.pieces):
            s = 0
            for b in p:
                c = child[s].get(kind[b])
                if c is None:
                    c = child[s][kind[b]] = len(child)
                    child.append({})
                s = c
            at[i] = s
        n = len(child)
        self.piece = np.full(n, -1, np.int32)
        self.piece[at] = np.arange(len(at))
        self.length, self.score = np.zeros(n, np.int64), np.zeros(n)
        self.length[at] = [len(p) for p in v.pieces]
        self.score[at] = v.scores
        self.next = np.zeros((n, kinds), np.int32)
        self.depth = np.zeros(n, np.int32)
        fail, self.link = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        level = [0]
        while level:  # by depth: a state first moves as its fallback does, then to its own children
            edges = np.array([(s, k, c) for s in level for k, c in child[s].items()], np.int64).reshape(-1, 3)
            here = np.array(level)
            if level != [0]:
                self.next[here] = self.next[fail[here]]
                self.link[here] = np.where(self.piece[fail[here]] >= 0, fail[here], self.link[fail[here]])
                fail[edges[:, 2]] = self.next[fail[edges[:, 0]], edges[:, 1]]
            self.next[edges[:, 0], edges[:, 1]] = edges[:, 2]
            self.depth[edges[:, 2]] = self.depth[edges[:, 0]] + 1
            level = edges[:, 2].tolist()
        self.head = np.where(self.piece >= 0, np.arange(n), self.link)
        self.longest = max((len(p) for p in v.pieces), default=1)
        self.marks_lead = not any(MARK in p.lstrip(MARK) for p in v.pieces)
        # words of the library's sums fall apart where the mark itself weighs so much that they are set back after it
        heavy = MARK in v.pieces and abs(v.scores[v.pieces.index(MARK)]) > FAR and abs(v.unknown) > FAR
        self.library = library and heavy and self.marks_lead and bool((v.scores == np.rint(v.scores)).all())

    def _block(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, paths: bool, first: np.ndarray | None = None):
        """Viterbi over words side by side, from the sums `first` where the library's rule holds: pieces by word, the steps' states and lengths if `paths`, and the last sums."""
        n, long = len(start), int(size.max())
        at = np.minimum(start[None, :] + np.arange(long)[:, None], len(text) - 1)
        raw = text[at]
        raw[np.arange(long)[:, None] >= size[None, :]] = 0x20  # ends a character; no piece holds a blank
        kind = self.kind[raw]
        ends = np.ones((long, n), bool)  # the last byte of a character
        ends[:-1] = (raw[1:] & 0xC0) != 0x80
        sums = np.float64 if first is None else np.float32
        best = np.full((long + 1, n), -np.inf, sums)
        best[0] = 0.0 if first is None else first
        weight, unknown = self.score.astype(sums), sums(self.v.unknown)
        count = np.zeros((long + 1, n), np.int64)
        came = np.full((long + 1, n), -1, np.int32) if paths else None
        span = np.zeros((long + 1, n), np.int32) if paths else None
        back_to = _Sums(long, n) if first is not None else None
        state, char = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for t in range(1, long + 1):
            state = self.next[state, kind[t - 1]]
            char += 1
            single = np.zeros(n, bool)
            cur = self.head[state]
            who = np.flatnonzero(cur >= 0)
            cur = cur[who]
            if back_to is not None:
                back_to.begin()
            while len(who):
                length = self.length[cur]
                score = best[t - length, who] + weight[cur]
                single[who[length == char[who]]] = True
                if back_to is not None:
                    back_to.catch_up(best, t, who, t - length)
                won = score > best[t, who]
                w, s, back = who[won], cur[won], length[won]
                best[t, w] = score[won]
                count[t, w] = count[t - back, w] + 1
                if paths:
                    came[t, w], span[t, w] = self.piece[s], back
                cur = self.link[cur]
                on = cur >= 0
                who, cur = who[on], cur[on]
            who = np.flatnonzero(ends[t - 1] & ~single)
            if len(who):
                back = char[who]
                score = best[t - back, who] + unknown
                if back_to is not None:
                    back_to.catch_up(best, t, who, t - back)
                won = score > best[t, who]
                w, back = who[won], back[won]
                best[t, w] = score[won]
                count[t, w] = count[t - back, w] + back
                if paths:
                    came[t, w], span[t, w] = -1, back
            if back_to is not None:
                back_to.finish(best, t, ends[t - 1] & (t < size))
            char[ends[t - 1]] = 0
        return count[size, np.arange(n)], came, span, best[size, np.arange(n)]

    def _states(self, kind: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """States after the bytes lo to hi of a long word, from parts that begin earlier by the longest piece."""
        begin = np.arange(lo, hi, _PART)
        lead = self.longest - 1
        out = np.zeros((_PART, len(begin)), np.int64)
        state = np.zeros(len(begin), np.int64)
        for t in range(-lead, _PART):
            at = begin + t
            state = np.where(at >= 0, self.next[state, kind[np.clip(at, 0, len(kind) - 1)]], 0)
            if t >= 0:
                out[t] = state
        return out.T.ravel()[: hi - lo]

    def _long(self, raw: np.ndarray, paths: bool, first: float | None = None) -> tuple[int, np.ndarray, float]:
        """Pieces of one long word, their ids if `paths`, and the last sum; from the sum `first` by the library's rule."""
        n, kind = len(raw), self.kind[raw]
        starts = (raw & 0xC0) != 0x80
        starts[0] = True
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        size = np.arange(n) - begin + 1  # bytes of the character so far
        ends = np.append(starts[1:], True)
        best, count = array("d", [0.0]) + array("d", [-np.inf]) * n, array("q", [0]) * (n + 1)
        came, span = (array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)) if paths else (None, None)
        far: list[tuple[int, float]] = []  # starts at which something was taken off, and what
        here, upto, best[0] = 0, 0, first or 0.0  # the end at hand, and how many of these its sum has seen
        for lo in range(0, n, _SPAN):
            hi = min(n, lo + _SPAN)
            cur = self.head[self._states(kind, lo, hi)]
            at = np.flatnonzero(cur >= 0)
            cur = cur[at]
            found = []
            single = np.zeros(hi - lo, bool)
            while len(at):
                single[at[self.length[cur] == size[lo + at]]] = True
                found.append((at, self.length[cur], self.score[cur], self.piece[cur]))
                cur = self.link[cur]
                on = cur >= 0
                at, cur = at[on], cur[on]
            # the longest first, an unknown character last
            at = np.flatnonzero(ends[lo:hi] & ~single)
            found.append((at, size[lo + at], np.full(len(at), self.v.unknown), np.full(len(at), -1)))
            at, back, score, piece = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(at, kind="stable")
            for t, b, x, p in zip((at[order] + lo + 1).tolist(), back[order].tolist(), score[order].tolist(), piece[order].tolist(), strict=True):
                if first is not None:
                    if t != here:
                        for end in range(here or 1, t):  # ends that are done, and those that nothing reached
                            upto = self._settle(best, end, far, upto if end == here else len(far), end < n)
                        here, upto = t, 0
                    while upto < len(far) and far[upto][0] <= t - b:
                        best[t] = _round(best[t] - far[upto][1])
                        upto += 1
                    x = _round(x + best[t - b])
                else:
                    x += best[t - b]
                if x > best[t]:
                    best[t], count[t] = x, count[t - b] + (b if p < 0 else 1)
                    if paths:
                        came[t], span[t] = p, b
        if first is not None and here:
            self._settle(best, here, far, upto, False)
        if not paths:
            return count[n], np.zeros(0, np.int32), best[n]
        steps, t = [], n
        while t > 0:
            steps.append((came[t], t - span[t], span[t]))
            t -= span[t]
        p, begin, back = np.array(steps[::-1], np.int64).T
        many = np.where(p < 0, back, 1)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        p, begin = np.repeat(p, many), np.repeat(begin, many)
        return count[n], np.where(p >= 0, self.v.ids[p], self.v.byte_ids[raw[np.minimum(begin + nth, n - 1)]]).astype(np.int32), best[n]

    @staticmethod
    def _settle(best, t: int, far: list[tuple[int, float]], upto: int, start: bool) -> int:
        """Ends the work on end t: what was taken off since its last candidate, and what it takes off what follows."""
        for _, x in far[upto:]:
            best[t] = _round(best[t] - x)
        if start and FAR < abs(best[t]) < np.inf:
            far.append((t, best[t]))
            best[t] = 0.0
        return len(far)

    def _paths(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, came, span) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block's words, word after word, from its table: ids, word of each."""
        pos, who = size.copy(), np.arange(len(size))
        steps = []
        while len(who):
            p, back = came[pos, who], span[pos, who].astype(np.int64)
            steps.append((who, p, pos - back, back))
            pos = pos - back
            who, pos = who[pos > 0], pos[pos > 0]
        word, p, begin, back = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((begin, word))
        word, p, begin, back = word[order], p[order], begin[order], back[order]
        n = np.where(p < 0, back, 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        word, p, begin = np.repeat(word, n), np.repeat(p, n), np.repeat(begin, n)
        return np.where(p >= 0, self.v.ids[p], self.v.byte_ids[text[np.minimum(start[word] + begin + nth, len(text) - 1)]]), word

    def words(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, paths: bool, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces by word, their ids one word after another, last sums)."""
        order = np.argsort(end - start, kind="stable")
        size = (end - start)[order]
        count, last = np.zeros(len(start), np.int64), np.zeros(len(start))
        ids: list[tuple[np.ndarray, np.ndarray]] = []
        lo, short = 0, int(np.searchsorted(size, _LONG))
        for i in order[short:].tolist():
            count[i], x, last[i] = self._long(text[start[i] : end[i]], paths, None if first is None else float(first[i]))
            ids.append((x, np.full(len(x), i)))
        order, size = order[:short], size[:short]
        while lo < len(order):
            hi = lo + max(1, int(_CELLS // max(1, size[min(lo + _CELLS // max(1, size[lo]), len(order) - 1)])))
            these = order[lo:hi]
            count[these], came, span, last[these] = self._block(text, start[these], size[lo:hi], paths, None if first is None else first[these])
            if paths:
                x, word = self._paths(text, start[these], size[lo:hi], came, span)
                ids.append((x, these[word]))
            lo = hi
        if not paths or not ids:
            return count, np.zeros(0, np.int32), last
        x, word = (np.concatenate(y) for y in zip(*ids, strict=True))
        return count, x[np.argsort(word, kind="stable")], last

    def segment(self, t: Texts, paths: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of rows as normalised by `marked`: (pieces by row, ids one row after another)."""
        n = len(t.buf)
        rows = len(t.off) - 1
        if not n:
            return np.zeros(rows, np.int64), np.zeros(0, np.int32)
        first = np.zeros(n + 1, bool)
        first[t.off] = True
        first = first[:n]
        mark = np.zeros(n, bool)
        if self.marks_lead:
            mark[: n - 2] = (t.buf[: n - 2] == MARK[0]) & (t.buf[1 : n - 1] == MARK[1]) & (t.buf[2:] == MARK[2])
            after = np.zeros(n, bool)
            after[3:] = mark[:-3]
            first = first | (mark & ~after)
        alone = self.alone[t.buf] & (t.buf < 0x80)
        first = first | alone
        first[1:] |= alone[:-1]
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        _, one, which = np.unique(t.hashes(start, end), return_index=True, return_inverse=True)
        if self.library:
            count, ids, which = self._chained(t, start, end, one, which, mark[start] & (end - start > len(MARK)), paths)
        else:
            count, ids, _ = self.words(t.buf, start[one], end[one], paths)
        own = count[which]
        at = np.searchsorted(start, t.off)
        total = np.concatenate([[0], np.cumsum(own)])
        by_row = total[at[1:]] - total[at[:-1]]
        if not paths:
            return by_row, np.zeros(0, np.int32)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1][which]
        place = np.repeat(begin - total[:-1], own) + np.arange(total[-1])
        return by_row, ids[place]

    def _first_sums(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Classes (word, first sum from -32 to 32) of first sums that read a word alike: those that round all its first pieces to the same multiples of 64."""
        turns = np.zeros((len(start), 65), bool)
        who, state = np.flatnonzero(marks), np.zeros(int(marks.sum()), np.int64)
        t = 0
        while len(who):
            state = self.next[state, self.kind[text[start[who] + t]]]
            t += 1
            on = self.depth[state] == t
            who, state = who[on], state[on]
            some = self.piece[state] >= 0
            # the sum that lies halfway between two multiples is on its own
            half = np.rint(32 - self.score[state[some]]).astype(np.int64) % 64
            for shift in (0, 1):
                at = (half + shift + 32) % 64  # place of that sum among -32 to 31
                turns[who[some], at] = True
                turns[who[some][at == 0], 64] = True
            on = t < size[who]
            who, state = who[on], state[on]
        turns[:, 0] = False
        return np.cumsum(turns, axis=1, dtype=np.uint8)

    def _chained(self, t: Texts, start: np.ndarray, end: np.ndarray, one: np.ndarray, which: np.ndarray, marks: np.ndarray, paths: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words by the library's rule: (pieces, ids) of words with the sums they are read from, and which of them each place has.

        A marked word's first sum matters only by what 32 bits lose of it next to the mark's score, a whole number of -32 to
        32. What comes before any other word is a byte without a piece, after which sums are set back, so these begin at 0.
        Each word is read from 0, then first sums follow from the words before, words with other ones are read from those, and
        so on until nothing changes. First sums that read a word alike count as one.
        """
        alike = self._first_sums(t.buf, start[one], (end - start)[one], marks[one])
        new = np.zeros(len(start) + 1, bool)
        new[np.searchsorted(start, t.off[:-1])] = True
        follows = marks & ~new[:-1]  # words whose first sum comes from the word before
        done: list[tuple[np.ndarray, np.ndarray]] = []
        known, slot, last = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted keys, numbers of their results; first sums of what follows, by number
        lead, mine, at = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), np.arange(len(start))
        while len(at):
            # only words whose first sum has changed, and then those after them
            key = which[at] * 128 + alike[which[at], lead[at] + 32]
            want, first = np.unique(key, return_index=True)
            place = np.searchsorted(known, want)
            fresh = known[np.minimum(place, len(known) - 1)] != want if len(known) else np.ones(len(want), bool)
            if fresh.any():
                of = at[first[fresh]]
                count, ids, ends = self.words(t.buf, start[of], end[of], paths, lead[of].astype(np.float32))
                done.append((count, ids))
                ends = np.where(np.abs(ends) > FAR, 0.0, ends)
                known, slot = np.insert(known, place[fresh], want[fresh]), np.insert(slot, place[fresh], len(last) + np.arange(len(of)))
                last = np.append(last, (ends - 64 * np.rint(ends / 64)).astype(np.int64))
            mine[at] = slot[np.searchsorted(known, key)]
            after = at[at + 1 < len(start)]
            after = after[follows[after + 1]] + 1
            again = last[mine[after - 1]]
            changed = again != lead[after]
            at = after[changed]
            lead[at] = again[changed]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done]), mine


def marked(buf: np.ndarray, off: np.ndarray) -> Texts:
    """Texts with space marks for blanks and one in front; empty ones as they are."""
    raw, at = buf.tobytes(), (off - off[0]).tolist()
    out = [MARK + raw[a:b].replace(b" ", MARK) if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
    return Texts(np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64))


def _automaton(shared) -> Automaton:
    """One for each Python worker, until it is put to other work."""
    if shared.id not in KEPT:
        KEPT.clear()
        KEPT[shared.id] = Automaton(shared.value, shared.library)
    return KEPT[shared.id]


class _Shared:
    """A broadcast vocabulary; `id` tells it from others in a worker that serves several."""

    def __init__(self, df: DataFrame, v: Vocabulary, library: bool = False):
        self._b = df.sparkSession.sparkContext.broadcast(v)
        self.library = library
        self.id = hash((library, v.unknown, len(v.pieces), v.pieces[0], v.pieces[-1], float(v.scores.sum())))

    @property
    def value(self) -> Vocabulary:
        return self._b.value


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def _offsets(n: np.ndarray, nulls: np.ndarray) -> pa.Array:
    x = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
    return pa.array(x, pa.int32(), mask=np.append(nulls, False)) if nulls.any() else pa.array(x, pa.int32())


def _encoded(a: Automaton, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Slices of batches with the ids of their texts (column 1)."""
    for batch in batches:
        buf, off = column(batch.column(1))
        for lo, hi in pieces(off, STRETCH):
            n, ids = a.segment(marked(buf[off[lo] : off[hi]], off[lo : hi + 1]), True)
            part = batch.slice(lo, hi - lo)
            yield part, pa.ListArray.from_arrays(_offsets(n, part.column(1).is_null().to_numpy(zero_copy_only=False)), pa.array(ids, pa.int32()))


class _Decoder:
    def __init__(self, v: Vocabulary):
        self.size = np.array([len(s) for s in v.surface])
        self.begin, self.raw = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(v.surface), np.uint8)

    def __call__(self, lists: pa.ListArray) -> Iterator[tuple[int, int, pa.Array]]:
        """Texts of ranges of rows of a column of ids."""
        of_row = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in pieces(np.concatenate([[0], np.cumsum(of_row)]), _IDS):
            part, n = lists.slice(lo, hi - lo), of_row[lo:hi]
            nulls = part.is_null().to_numpy(zero_copy_only=False)
            ids = part.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            ids = np.where((ids < 0) | (ids >= len(self.size)), 0, ids)
            each = self.size[ids]
            total = np.concatenate([[0], np.cumsum(each)])
            out = self.raw[np.repeat(self.begin[ids] - total[:-1], each) + np.arange(total[-1])].tobytes()
            row = total[np.concatenate([[0], np.cumsum(n)])].tolist()
            texts = [None if null else out[a + (out[a : a + 1] == b" ") : b].decode("utf-8", "replace") if b > a else "" for a, b, null in zip(row[:-1], row[1:], nulls.tolist(), strict=True)]
            yield lo, hi, pa.array(texts, pa.string())


def encode(df: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", library: bool = True) -> DataFrame:
    """(doc_id, text, ids) for each row of `df`."""
    shared = _Shared(df, vocabulary or Vocabulary.load(), library)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids in _encoded(_automaton(shared), batches):
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=["doc_id", "text", "ids"])

    return _docs(df, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(df: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`df` with the text of `ids_col` in `out_col`. Null ids and ids outside the vocabulary decode as unknown, null lists as null."""
    shared = _Shared(df, vocabulary or Vocabulary.load())
    kept = [c for c in df.columns if c != out_col]
    at = kept.index(ids_col)
    schema = df.select(*kept).schema.add(out_col, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = _Decoder(shared.value)
        for batch in batches:
            for lo, hi, texts in texts_of(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, texts], names=[*kept, out_col])

    return df.select(*kept).mapInArrow(run, schema)


def round_trip(df: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", library: bool = True) -> DataFrame:
    """(doc_id, text, ids, decoded): `encode` and `decode` in one pass, with one Python worker for a task instead of two."""
    shared = _Shared(df, vocabulary or Vocabulary.load(), library)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = _Decoder(shared.value)
        for part, ids in _encoded(_automaton(shared), batches):
            for lo, hi, texts in texts_of(ids):
                yield pa.RecordBatch.from_arrays([*part.slice(lo, hi - lo).columns, ids.slice(lo, hi - lo), texts], names=["doc_id", "text", "ids", "decoded"])

    return _docs(df, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def token_counts(df: DataFrame, vocabulary: Vocabulary | None = None, id_col: str = "doc_id", text_col: str = "text", library: bool = True) -> DataFrame:
    """(doc_id, n_tokens) for each row of `df`: as many as `encode` gives, without keeping paths."""
    shared = _Shared(df, vocabulary or Vocabulary.load(), library)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(shared)
        for batch in batches:
            buf, off = column(batch.column(1))
            for lo, hi in pieces(off, STRETCH):
                n, _ = a.segment(marked(buf[off[lo] : off[hi]], off[lo : hi + 1]), False)
                nulls = batch.column(1).slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64(), mask=nulls)], names=["doc_id", "n_tokens"])

    return _docs(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")
