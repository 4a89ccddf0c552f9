"""Garbled text from wrong character encoding (problem 8): a hidden Markov model over the characters.

One clean state and one state per encoding pair (the encoding a text had, the one it was read in) label the runs of non-ASCII characters of a text;
each labelled span gets its state's inverse transform. A state's emission is the probability, under a character bigram model of clean text, of what
its inverse makes of the run and its ASCII neighbours. The bigram counts come from all documents in one combining pass (the alphabet bounds them); what a
pair's misreading of frequent bigrams explains is taken out of them, and so are sequences that are well-formed UTF-8 in some reading. The texts repaired
with this model are counted once more, for the model that labels them.

Inside a task all runs of a block of documents are scored at once with array operations, and the Viterbi recursion runs over all documents in step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Readings of UTF-8 that the model knows, then pairs of single-byte encodings (what it was, what it was read as).
UTF8_READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "koi8-r", "cp866", "iso8859-2", "iso8859-7"]
SINGLE = [
    ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "cp1250"), ("cp1252", "cp1253"), ("cp1252", "koi8-r"),
    ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1251", "cp866"), ("cp1251", "mac_roman"),
    ("cp850", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("iso8859-2", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1250"), ("cp1250", "iso8859-2"), ("iso8859-7", "cp1252"), ("cp1253", "cp1252"), ("cp1254", "cp1252"),
]
TWICE = ["cp1252", "latin-1"]
STATES = ["clean", *[f"utf-8 as {r}" for r in UTF8_READ_AS], *[f"utf-8 as {r}, twice" for r in TWICE], *[f"{t} as {r}" for t, r in SINGLE], "lost"]

LOST = 0xFFFD
FLOOR = -14.0  # of a log probability
INVALID = -8.0  # for a character that a state's inverse has no use for
FOREIGN = -6.0  # for a decoded word of another script next to a Latin letter
KEPT = -2.5  # for a run that stays as it is inside a span, as characters do that the original encoding lacked
ENTER_UTF8, ENTER_SINGLE, LEAVE = -7.0, -14.0, -4.0
#: The share of a bigram's count that one pair may have misread, with one non-ASCII character and with two: before anything was repaired (of a third of all texts
#: misread one way, half as often as right), and for what a first repair left.
EXPLAINED, EXPLAINED_AFTER = (0.6, 0.6), (0.1, 0.5)
STRANGE, SEEN = -6.0, 2e-6  # for a decoded character that clean text hardly has: less than this share of its counted bigrams
UNKNOWN = -10.0  # for the character itself where the alphabet only has "another"
_SCATTER = np.random.default_rng(0).integers(1, 2**63, 4096, dtype=np.uint64)  # fixed random numbers to tell runs apart by
BLOCK = 1_000_000  # characters of texts that are scored together, at least one whole text
QUIET = 10  # so many runs in a row on which no state does better than KEPT part a text: see label_runs


def byte_chars(codec: str) -> list[int]:
    """The code point each byte is read as; bytes without a character are read as the control of the same number."""
    out = []
    for b in range(256):
        try:
            out.append(ord(bytes([b]).decode(codec)))
        except UnicodeDecodeError:
            out.append(b)
    return out


@dataclass
class Alphabet:
    codes: np.ndarray  # id -> code point; ASCII first, the last id is for all others
    ids: np.ndarray  # code point -> id
    size: int
    bytes_of: dict[str, np.ndarray]  # reading -> id -> byte, 0 for ASCII and none
    inverse: np.ndarray  # single pair -> id -> id of the original, -1 for none
    foreign: np.ndarray  # id -> letter of a script other than Latin
    fold: np.ndarray  # id -> id without case
    case: np.ndarray  # id -> 0 no letter with case, 1 lower, 2 upper


@lru_cache(maxsize=1)
def alphabet() -> Alphabet:
    codecs = sorted({*UTF8_READ_AS, *(x for p in SINGLE for x in p)})
    tables = {c: byte_chars(c) for c in codecs}
    extra = sorted({c for t in tables.values() for c in t if c > 127} | {LOST, 0xFEFF, 0x266A, 0x266B})
    codes = np.array([*range(128), *extra, 0], dtype=np.int64)
    other = len(codes) - 1
    ids = np.full(0x110000, other, dtype=np.int32)
    ids[codes[:other]] = np.arange(other)
    ids[ord("1") : ord("9") + 1] = ids[ord("0")]  # digits are alike
    bytes_of = {}
    for c, t in tables.items():
        of = np.zeros(len(codes), dtype=np.int32)
        for b in range(255, 127, -1):
            if t[b] > 127:
                of[ids[t[b]]] = b
        bytes_of[c] = of
    inverse = np.full((len(SINGLE), len(codes)), -1, dtype=np.int32)
    for k, (true, read) in enumerate(SINGLE):
        inverse[k, :128] = np.arange(128)
        inverse[k, ids[np.arange(128)]] = ids[np.arange(128)]
        for b in range(128, 256):
            if tables[read][b] > 127 and tables[true][b] > 127:
                inverse[k, ids[tables[read][b]]] = ids[tables[true][b]]
    foreign = np.array([chr(c).isalpha() and c > 0x24F and c != 0xAA and c != 0xBA for c in codes])
    lower = [chr(c).lower() for c in codes]
    fold = np.array([ids[ord(x)] if len(x) == 1 and ids[ord(x)] != other else i for i, x in enumerate(lower)])
    fold[ids[ord("0")]] = ids[ord("0")]
    case = np.array([2 if chr(c).isupper() else 1 if chr(c).islower() else 0 for c in codes])
    return Alphabet(codes, ids, len(codes), bytes_of, inverse, foreign, fold, case)


def _block(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, each after a line end, and the start of each; one more line end closes the block."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    joined = "\n" + "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), starts[:-1]


def _utf8(ids: np.ndarray, byte: np.ndarray, a: Alphabet, known: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Well-formed UTF-8 in ``ids`` under a reading: for each position whether it stays after decoding, the id there, and whether it belongs to a sequence.
    ``known``: only sequences of characters that the alphabet has."""
    b = byte[ids]
    n = len(b)
    pad = np.zeros(n + 3, dtype=np.int32)
    pad[:n] = b
    c1, c2, c3 = ((pad[k : n + k] & 0xC0) == 0x80 for k in (1, 2, 3))
    two = (b >= 0xC2) & (b <= 0xDF) & c1
    three = (b >= 0xE0) & (b <= 0xEF) & c1 & c2
    four = (b >= 0xF0) & (b <= 0xF4) & c1 & c2 & c3
    code = np.zeros(n, dtype=np.int64)
    x, y, z = (pad[k : n + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
    code[two] = ((b[two].astype(np.int64) & 0x1F) << 6) | x[two]
    code[three] = ((b[three].astype(np.int64) & 0xF) << 12) | (x[three] << 6) | y[three]
    code[four] = ((b[four].astype(np.int64) & 7) << 18) | (x[four] << 12) | (y[four] << 6) | z[four]
    three &= ~((code >= 0xD800) & (code < 0xE000)) & (code >= 0x800)
    four &= (code >= 0x10000) & (code < 0x110000)
    start = two | three | four
    if known:
        start &= a.ids[np.where(start, code, 0)] < a.size - 1
        two, three, four = two & start, three & start, four & start
    part = start.copy()
    part[1:] |= start[:-1]
    part[2:] |= (three | four)[:-2]
    part[3:] |= four[:-3]
    keep = ~part | start
    out = np.where(start, a.ids[np.where(start, code, 0)], ids)
    return keep, out, part


def _add_counts(texts: list[str], total: np.ndarray, single: np.ndarray, sign: int = 1) -> None:
    """Add (or take off) one block's counts of character pairs with a non-ASCII one, outside sequences that are UTF-8 in some reading, and of characters."""
    a = alphabet()
    codes, _ = _block(texts)
    ids = a.ids[codes]
    wide = ids >= 128
    near = wide.copy()
    near[1:] |= wide[:-1]
    near[:-1] |= wide[1:]
    at = np.flatnonzero(near)
    local = ids[at]
    bad = np.zeros(len(at), dtype=bool)
    for r in UTF8_READ_AS:
        bad |= _utf8(local, a.bytes_of[r], a, known=True)[2]
    pair = (np.diff(at) == 1) & (wide[at[:-1]] | wide[at[1:]]) & ~bad[:-1] & ~bad[1:]
    key = local[:-1][pair].astype(np.int64) * a.size + local[1:][pair]
    total += sign * np.bincount(key, minlength=len(total))
    single += sign * np.bincount(ids, minlength=a.size)


def bigram_counts(docs: DataFrame, repaired_by: np.ndarray | None = None) -> DataFrame:
    """``a, b, n``: how often each pair of characters with a non-ASCII one follows each other in all texts, outside sequences that are UTF-8 in some
    reading; ``b`` = -1 has the character's own count. At most (alphabet size)^2 rows. ``repaired_by`` a model: what repairing the texts changes in these counts."""
    model = docs.sparkSession.sparkContext.broadcast(repaired_by)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = alphabet()
        total, single = np.zeros(a.size * a.size, dtype=np.int64), np.zeros(a.size, dtype=np.int64)
        for batch in batches:
            for texts, _ in blocks(batch["text"]):
                if model.value is None:
                    _add_counts(texts, total, single)
                    continue
                changed = [(old, new) for old, (new, _) in zip(texts, repair(texts, model.value), strict=True) if old != new]
                if changed:
                    _add_counts([old for old, _ in changed], total, single, -1)
                    _add_counts([new for _, new in changed], total, single)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"a": at // a.size, "b": at % a.size, "n": total[at]})
        at = np.flatnonzero(single)
        yield pd.DataFrame({"a": at, "b": np.full(len(at), -1), "n": single[at]})

    parts = docs.select("text").where("text IS NOT NULL").mapInPandas(count, "a bigint, b bigint, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def clean_model(counts: pd.DataFrame, explained_share: tuple[float, float] = EXPLAINED) -> np.ndarray:
    """Log probabilities of the next character in clean text, an array of alphabet size squared, and a last row with what a state loses for making a character
    that clean text hardly has."""
    a = alphabet()
    n = np.zeros((a.size, a.size))
    own = np.zeros(a.size)
    pairs = counts[counts["b"] >= 0]
    n[pairs["a"], pairs["b"]] = pairs["n"]
    lone = counts[counts["b"] < 0]
    own[lone["a"]] = lone["n"]
    explained = np.zeros_like(n)
    for inv in a.inverse:
        at = np.flatnonzero(inv >= 0)
        moved = inv[at] != at
        share = np.where(moved[:, None] & moved[None, :], explained_share[1], explained_share[0]) * (moved[:, None] | moved[None, :])
        cell = np.ix_(at, at)
        explained[cell] = np.maximum(explained[cell], n[np.ix_(inv[at], inv[at])] * share)
    left = np.maximum(0, n - explained)
    left[:, a.ids[LOST]] = left[a.ids[LOST], :] = 0  # a replacement character is never clean
    # letters without their case, times the case after the case before
    ascii_id = np.arange(a.size) < 128
    context = np.bincount(a.fold, weights=np.where(ascii_id, own, left.sum(axis=1)), minlength=a.size)
    q = np.bincount(a.fold, weights=np.where(ascii_id, own, left.sum(axis=0)), minlength=a.size) + 0.5
    q /= q.sum()
    folded = np.zeros_like(left)
    np.add.at(folded, (a.fold[:, None], a.fold[None, :]), left)
    p = np.log((folded + q[None, :]) / (context + 1)[:, None])[a.fold][:, a.fold]
    case = np.zeros((3, 3))
    np.add.at(case, (a.case[:, None], a.case[None, :]), left)
    case[:, 1:] += 1
    with np.errstate(divide="ignore"):
        case = np.log(case / case[:, 1:].sum(axis=1, keepdims=True))
    case[:, 0] = 0  # no letter
    p += case[a.case][:, a.case]
    p[:, -1] += UNKNOWN
    p = np.maximum(FLOOR + np.where(np.arange(a.size) == a.size - 1, UNKNOWN, 0)[None, :], p)
    seen = np.bincount(a.fold, weights=left.sum(axis=0), minlength=a.size)[a.fold]
    return np.vstack([p, np.where(seen > SEEN * left.sum(), 0, STRANGE)]).astype(np.float32)


def blocks(texts: pd.Series) -> Iterator[tuple[list[str], list[int]]]:
    """Whole texts in blocks of about BLOCK characters, with the row number of each; null and empty ones are left out."""
    out, rows, size = [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        out.append(t)
        rows.append(i)
        size += len(t)
        if size >= BLOCK:
            yield out, rows
            out, rows, size = [], [], 0
    if out:
        yield out, rows


def run_gains(codes: np.ndarray, lp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-ASCII characters, the text it is in, and the log probability that each state gives it above the clean state's."""
    a = alphabet()
    ids = a.ids[codes]
    wide = codes >= 128
    edge = np.flatnonzero(np.diff(wide.astype(np.int8)))
    begin, end = edge[::2] + 1, edge[1::2] + 1  # a block starts and ends with a line end
    piece = np.searchsorted(starts, begin, side="right") - 1
    if not len(begin):
        return begin, end, piece, np.zeros((0, len(STATES)), dtype=np.float32)
    # each run with the character before and after it, one after the other; equal ones are scored once
    length = end - begin + 2
    first = np.cumsum(length) - length
    run = np.repeat(np.arange(len(begin)), length)
    local = ids[np.arange(length.sum()) - first[run] + begin[run] - 1]
    at = np.arange(len(local)) - first[run]
    key = np.add.reduceat(_SCATTER[local] * _SCATTER[at % len(_SCATTER)], first)
    _, one, same = np.unique(key, return_index=True, return_inverse=True)
    chosen = np.zeros(len(begin), dtype=bool)
    chosen[one] = True
    gains, strange = _state_gains(local[chosen[run]], np.repeat(np.arange(len(one)), length[chosen]), lp)
    place = np.empty(len(one), dtype=np.int64)
    place[np.argsort(one)] = np.arange(len(one))
    same = place[same]
    # the nearest letter on either side, beyond what is no letter
    latin = ((codes | 32) >= 97) & ((codes | 32) <= 122) & (codes < 128)
    letter = latin | wide
    before = np.maximum.accumulate(np.where(letter, np.arange(len(codes)), 0))[begin - 1]
    after = np.minimum.accumulate(np.where(letter, np.arange(len(codes)), len(codes) - 1)[::-1])[::-1][end]
    beside = latin[before].astype(np.float32) + latin[after]
    return begin, end, piece, gains[same] + FOREIGN * beside[:, None] * strange[same]


def _state_gains(local: np.ndarray, run: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs with their neighbours (ids and run numbers): every state's log probability above the clean one's, and whether the state
    makes letters of another script of a run that has none."""
    a = alphabet()
    runs = run[-1] + 1

    def score(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        same = np.flatnonzero(r[1:] == r[:-1])
        return np.bincount(r[same], weights=lp[x[same], x[same + 1]], minlength=runs)

    clean = score(local, run)
    inner = local >= 128
    gains = np.full((runs, len(STATES)), -1e3, dtype=np.float32)
    gains[:, 0] = 0
    foreign = np.zeros((runs, len(STATES)), dtype=bool)
    already = np.zeros(runs, dtype=bool)
    already[run[a.foreign[local]]] = True

    def put(state: int, x: np.ndarray, r: np.ndarray, unused: np.ndarray, made: np.ndarray) -> None:
        strange = np.bincount(r[made], weights=lp[-1][x[made]], minlength=runs)
        gains[:, state] = score(x, r) - clean + INVALID * np.bincount(unused, minlength=runs) + strange
        foreign[r[a.foreign[x]], state] = True
        foreign[already, state] = False

    for k, read in enumerate([*UTF8_READ_AS, *TWICE], 1):
        keep, out, part = _utf8(local, a.bytes_of[read], a)
        if not part.any():
            continue
        x, r, unused, made = out[keep], run[keep], run[inner & ~part], part[keep]
        if k > len(UTF8_READ_AS):
            wide2 = x >= 128
            keep, out, part = _utf8(x, a.bytes_of[read], a)
            if not part.any():
                continue
            unused = np.concatenate([unused, r[wide2 & ~part]])
            x, r, made = out[keep], r[keep], part[keep]
        put(k, x, r, unused, made)
        untouched = np.ones(runs, dtype=bool)
        untouched[run[part] if k <= len(UTF8_READ_AS) else r] = False
        gains[untouched, k] = INVALID
    base = len(UTF8_READ_AS) + len(TWICE) + 1
    for j, inv in enumerate(a.inverse):
        to = inv[local]
        x = np.where(to >= 0, to, local)
        put(base + j, x, run, run[(to < 0) & inner], x != local)
    lost = np.bincount(run[local == a.ids[LOST]], minlength=runs)
    gains[:, -1] = np.where(lost > 0, 20.0 * lost, -20.0)
    return gains, foreign


def stretches(piece: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """A number for every run, in order, that changes with the text and in the middle of QUIET runs on which no state does better than KEPT.

    On such runs a state costs KEPT each. To leave it at the first of them and enter any state after the last costs LEAVE and an entry, which is
    less than QUIET times KEPT; so the best path through the whole text is clean in the middle, and its parts can be labelled on their own."""
    quiet = gains[:, 1:].max(axis=1, initial=-np.inf) <= KEPT
    new = np.ones(len(piece), dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (quiet[1:] != quiet[:-1])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(piece)))
    middle = (first + length // 2)[quiet[first] & (length >= QUIET)]
    cut = np.zeros(len(piece), dtype=bool)
    cut[1:] = piece[1:] != piece[:-1]
    cut[middle] = True
    return np.cumsum(cut)


def label_runs(text: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """The state of every run on the best path through each whole text; ``text`` numbers the runs' texts in order. Only stretches in which some run gains can leave the clean state."""
    labels = np.zeros(len(text), dtype=np.int16)
    piece = stretches(text, gains)
    hot = np.zeros(piece.max() + 1 if len(piece) else 0, dtype=bool)
    hot[piece[gains[:, 1:].max(axis=1) > 0]] = True
    at = np.flatnonzero(hot[piece])
    if not len(at):
        return labels
    names, seq = np.unique(piece[at], return_inverse=True)
    length = np.bincount(seq)
    start = np.cumsum(length) - length
    enter = np.array([LEAVE] + [ENTER_UTF8] * (len(UTF8_READ_AS) + len(TWICE)) + [ENTER_SINGLE] * len(SINGLE) + [ENTER_UTF8], dtype=np.float32)
    floor = np.full(len(STATES), KEPT, dtype=np.float32)
    floor[0] = 0
    order = np.argsort(-length, kind="stable")
    v = np.tile(enter, (len(names), 1))
    v[:, 0] = 0
    from_state = np.zeros((len(at), len(STATES)), dtype=np.int8)
    ends = np.zeros(len(names), dtype=np.int64)
    for t in range(length.max()):
        live = order[: np.searchsorted(-length[order], -t, side="left")]  # those longer than t
        pos = start[live] + t
        now = v[live]
        if t:
            best = now.argmax(axis=1)
            jump = now[np.arange(len(live)), best][:, None] + enter[None, :]
            move = jump > now
            from_state[pos] = np.where(move, best[:, None], np.arange(len(STATES))[None, :])
            now = np.where(move, jump, now)
        now = now + np.maximum(gains[at[pos]], floor)
        v[live] = now
        ends[live] = now.argmax(axis=1)
    state = ends
    for t in range(length.max() - 1, -1, -1):
        live = order[: np.searchsorted(-length[order], -t, side="left")]
        pos = start[live] + t
        labels[at[pos]] = state[live]
        state[live] = from_state[pos, state[live]]
    labels[gains[np.arange(len(labels)), labels] < KEPT] = 0
    return labels


@lru_cache(maxsize=64)
def _char_bytes(read: str) -> dict[str, int]:
    return {chr(c): b for b, c in reversed(list(enumerate(byte_chars(read)))) if b > 127 and c > 127}


def _from_utf8(run: str, read: str) -> str:
    """The run with its well-formed UTF-8 sequences decoded, the rest as it was."""
    to = _char_bytes(read)
    out, i = [], 0
    while i < len(run):
        b = to.get(run[i], 0)
        n = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
        try:
            out.append(bytes(to[c] for c in run[i : i + n]).decode("utf-8") if n > 1 and len(run) - i >= n else run[i])
        except (KeyError, UnicodeDecodeError):
            out.append(run[i])
            n = 1
        i += n if n > 1 and len(run) - i >= n else 1
    return "".join(out)


@lru_cache(maxsize=200_000)
def invert(run: str, state: int) -> str:
    """The inverse transform of a state; characters it has no use for stay."""
    name = STATES[state]
    if name in ("clean", "lost"):
        return run
    true, read = name.removesuffix(", twice").split(" as ")
    if true == "utf-8":
        once = _from_utf8(run, read)
        return _from_utf8(once, read) if name.endswith("twice") else once
    to, chars = _char_bytes(read), byte_chars(true)
    return "".join(chr(chars[to[c]]) if c in to else c for c in run)


def repair(texts: list[str], lp: np.ndarray) -> list[tuple[str, dict[str, int]]]:
    """For each text of one block: the text with its labelled runs inverted, and the number of runs in each state other than clean.

    A text is one sequence, whatever its length; a block holds its runs by states in memory, about 200 bytes a run."""
    codes, starts = _block(texts)
    begin, end, piece, gains = run_gains(codes, lp, starts)
    labels = label_runs(piece, gains)
    out: list[tuple[str, dict[str, int]]] = [(t, {}) for t in texts]
    wrong = np.flatnonzero(labels)
    for i in np.unique(piece[wrong]):
        text, done, last, states = texts[i], [], 0, {}
        base = starts[i] + 1
        for r in wrong[np.searchsorted(piece[wrong], i) : np.searchsorted(piece[wrong], i, side="right")]:
            s, e = begin[r] - base, end[r] - base
            done += [text[last:s], invert(text[s:e], int(labels[r]))]
            last = e
            states[STATES[labels[r]]] = states.get(STATES[labels[r]], 0) + 1
        out[i] = ("".join([*done, text[last:]]), states)
    return out


def repaired(texts: pd.Series, lp: np.ndarray) -> tuple[list[str | None], list[dict[str, int]]]:
    """Texts restored, and their states; null and empty texts stay."""
    out: list[str | None] = list(texts)
    states: list[dict[str, int]] = [{} for _ in out]
    for block, rows in blocks(texts):
        for found, i in zip(repair(block, lp), rows, strict=True):
            out[i], states[i] = found
    return out, states


def fit(docs: DataFrame, refits: int = 1) -> np.ndarray:
    """The clean model of a corpus; the driver gets only the counts of character pairs, bounded by the alphabet.

    A refit repairs all texts with the model so far and counts again, so that texts misread one way count as what they were, even where they are a third of all."""
    counts = bigram_counts(docs).toPandas()
    lp = clean_model(counts)
    for _ in range(refits):
        counts = pd.concat([counts, bigram_counts(docs, lp).toPandas()]).groupby(["a", "b"], as_index=False)["n"].sum()
        lp = clean_model(counts, EXPLAINED_AFTER)
    return lp


def restore_documents(docs: DataFrame, lp: np.ndarray) -> DataFrame:
    """``doc_id, text, states``: every document with runs in a state other than clean, its text restored where the state has an inverse, and the states.

    ``docs`` has doc_id and text; null and empty texts are never affected; repeated rows come repeatedly; other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(lp)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, states = repaired(b["text"], model.value)
            hit = [i for i, s in enumerate(states) if s]
            yield pd.DataFrame({"doc_id": b["doc_id"].iloc[hit], "text": [texts[i] for i in hit], "states": [", ".join(sorted(states[i], key=lambda k: (-states[i][k], k))) for i in hit]}, dtype=object)  # noqa: B023

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(work, "doc_id string, text string, states string")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))
