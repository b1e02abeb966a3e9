"""Counts over whole texts, for a batch of rows at once."""

from __future__ import annotations

import numpy as np

from .textscan import BLANK, NON_ALNUM, U64, inside_rows, mix, span_hashes, windows, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: The first byte of each code point.
HEAD = np.ones(256, bool)
HEAD[0x80:0xC0] = False


def per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over rows."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def repeated_window_words(codes: np.ndarray, first: np.ndarray, k: int = 3) -> np.ndarray:
    """For each row, the words that stand in a k-word window found twice or more in the row."""
    n = len(codes)
    if n < k:
        return np.zeros(len(first) - 1, np.int64)
    where = np.flatnonzero(inside_rows(first, k))
    row = np.searchsorted(first, where, side="right") - 1
    keys = mix(windows(codes, k)[where] ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, where[twice], 1)
    np.add.at(cover, where[twice] + k, -1)
    return per_row(np.cumsum(cover[:-1]) > 0, first)


def lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each \\n-split line of every row, and each line's row."""
    ends = np.flatnonzero(raw == 0x0A)
    row_of = np.searchsorted(at, ends, side="right") - 1
    starts = np.concatenate([at[:-1], ends + 1])
    stops = np.concatenate([ends, at[1:]])
    rows = np.concatenate([np.arange(len(at) - 1), row_of])
    order = np.lexsort((starts, rows))
    stop_rows = np.concatenate([row_of, np.arange(len(at) - 1)])
    back = np.lexsort((stops, stop_rows))
    return starts[order], stops[back], rows[order]


def duplicate_lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: lines that have a word and equal an earlier line of the row, and lines that have a word."""
    start, stop, row = lines(raw, at)
    total = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(~BLANK[raw], out=total[1:])
    full = total[stop] > total[start]
    start, stop, row = start[full], stop[full], row[full]
    keys = mix(span_hashes(raw, start, stop) ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    n = len(at) - 1
    return np.bincount(row[again], minlength=n), np.bincount(row, minlength=n)


class Stats:
    """Lazily computed counts of a piece of rows (bytes and row bounds); each is an array with one number a row."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.raw, self.at, self.held = raw, at, {}

    def __getattr__(self, name: str):
        if name.startswith("_") or name in ("raw", "at", "held"):
            raise AttributeError(name)
        if name not in self.held:
            self.held[name] = getattr(self, f"get_{name}")()
        return self.held[name]

    def narrow(self, keep: np.ndarray) -> Stats:
        """The statistics of some rows only; what is known of them is kept."""
        if keep.all():
            return self
        sizes = np.diff(self.at)
        gone = np.concatenate([[0], np.cumsum(np.where(keep, 0, sizes))])[:-1]
        out = Stats(self.raw[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])]))
        for name, value in self.held.items():
            if name == "line_counts":
                out.held[name] = tuple(x[keep] for x in value)
            elif name not in ("cut", "codes"):
                out.held[name] = value[keep]
        if "cut" in self.held:
            start, end, first = self.held["cut"]
            count = np.diff(first)
            word = np.repeat(keep, count)
            shift = np.repeat(gone, count)[word]
            out.held["cut"] = (start[word] - shift, end[word] - shift, np.concatenate([[0], np.cumsum(count[keep])]))
            if "codes" in self.held:
                out.held["codes"] = self.held["codes"][word]
        return out

    def of(self, flags: np.ndarray) -> np.ndarray:
        return per_row(flags, self.at)

    def get_cut(self):
        return words(self.raw, self.at)

    def get_codes(self):
        return span_hashes(self.raw, self.cut[0], self.cut[1])

    def get_n_words(self):
        return np.diff(self.cut[2])

    def get_n_chars(self):
        return self.of(HEAD[self.raw])

    def get_word_chars(self):
        return self.of(HEAD[self.raw] & ~BLANK[self.raw])

    def get_n_symbols(self):
        return self.of(SYMBOL[self.raw])

    def get_n_dup_lines(self):
        return self.line_counts[0]

    def get_n_lines(self):
        return self.line_counts[1]

    def get_line_counts(self):
        return duplicate_lines(self.raw, self.at)

    def get_n_repeat_words(self):
        return repeated_window_words(self.codes, self.cut[2])

    def get_n_distinct(self):
        row = np.repeat(np.arange(len(self.at) - 1), self.n_words)
        keys = mix(self.codes ^ mix(row.astype(U64) + U64(1)))
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        return np.bincount(row[order][new], minlength=len(self.at) - 1)

    def get_n_upper(self):
        """A-Z, and the capitals of Latin-1, whose second byte is 80 to 9E after C3."""
        two = np.zeros(len(self.raw), bool)
        two[1:] = (self.raw[:-1] == 0xC3) & (self.raw[1:] >= 0x80) & (self.raw[1:] <= 0x9E)
        return self.of(((self.raw >= 0x41) & (self.raw <= 0x5A)) | two)

    def get_n_letters(self):
        upper = (self.raw & 0xDF) - 0x41 < 26
        return self.of(upper | (self.raw >= 0xC0))

    def get_n_digits(self):
        return self.of((self.raw - 0x30) < 10)

    def get_n_exclaim(self):
        return self.of(self.raw == 0x21)

    def get_n_pipes(self):
        return self.of(self.raw == 0x7C)

    def get_n_punct(self):
        return self.of(NON_ALNUM[self.raw] & ~BLANK[self.raw])

    def get_n_alpha_words(self):
        """Words with a letter."""
        total = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(((self.raw & 0xDF) - 0x41 < 26) | (self.raw >= 0xC0), out=total[1:])
        start, end, first = self.cut
        return per_row(total[end] > total[start], first)

    def get_n_odd_ends(self):
        """Words whose last byte is a symbol or an exclamation mark."""
        start, end, first = self.cut
        last = self.raw[end - 1]
        return per_row(SYMBOL[last] | (last == 0x21), first)

    def get_n_stutter(self):
        """Words equal to the word before them in their row."""
        same = np.zeros(len(self.codes), bool)
        same[1:] = self.codes[1:] == self.codes[:-1]
        first = self.cut[2]
        same[first[:-1][first[:-1] < len(same)]] = False
        return per_row(same, first)
