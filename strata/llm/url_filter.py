"""URL filters by a bit-parallel wildcard automaton.

Every glob of every rule is packed into one row of 64-bit words, a bit for
each place in a glob; a byte of the url moves all places of all globs at once
(Shift-And).  The words of many urls form a matrix, so one numpy operation
moves all urls of a batch.

Globs run over the canonical url, host then path: ``?`` is one byte but ``/``,
``*`` a run of bytes without ``/``, ``**`` any run.  They must cover the whole
canonical url.  Of the rules that fit, the one with the longest ``rank`` wins;
equal ranks: the first in the list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.layout import lower_ascii
from strata.llm.words import as_bytes

U = np.uint64


@dataclass(frozen=True)
class Rule:
    verdict: str
    name: str
    globs: tuple[str, ...]
    rank: int = 0


def host_rule(verdict: str, host_and_path: str) -> Rule:
    """A host with all its subdomains, and a path prefix; the longest such rule wins."""
    return Rule(verdict, host_and_path, (f"{host_and_path}**", f"*.{host_and_path}**"), len(host_and_path))


class Automaton:
    """Shift-And masks of all globs.

    A glob of m single-byte places has m + 1 bits; bit j says that j places
    are matched.  ``move[c]`` has bit j where byte c takes place j on, and
    ``stay[c]`` has it where a wildcard before place j swallows c.  The last
    bit of a glob never moves, so the shift across words needs no guard.
    """

    PAD = 256  # past the url's end: nothing moves, everything stays

    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda r: -r.rank)  # stable: ties keep the list's order
        move, stay, self.start, self.accept = [], [], [], []
        for rule in self.rules:
            ends = []
            for glob in rule.globs:
                at = len(move)
                self.start.append(at)
                move.append(np.zeros(257, bool))
                stay.append(np.zeros(257, bool))
                raw, i = glob.encode(), 0
                while i < len(raw):
                    if raw[i : i + 2] == b"**":
                        stay[-1][:256] = True
                        i += 2
                        continue
                    if raw[i] == ord("*"):
                        stay[-1][:256] |= np.arange(256) != ord("/")
                        i += 1
                        continue
                    move[-1][:256] = np.arange(256) != ord("/") if raw[i] == ord("?") else np.arange(256) == raw[i]
                    move.append(np.zeros(257, bool))
                    stay.append(np.zeros(257, bool))
                    i += 1
                ends.append(len(move) - 1)
            self.accept.append(ends)
        self.words = max(1, -(-len(move) // 64))
        self.move, self.stay = self._pack(move), self._pack(stay)

    def _pack(self, bits: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((257, self.words), np.uint64)
        for j, b in enumerate(bits):
            out[:, j // 64] |= b.astype(np.uint64) << U(j % 64)
        return out

    def winners(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Index of the winning rule of each url, -1 if none fits."""
        lengths = np.diff(offs)
        order = np.argsort(-lengths, kind="stable")  # urls that go on stay in front
        starts, lengths = offs[:-1][order], lengths[order]
        state = np.zeros((len(order), self.words), np.uint64)
        for j in self.start:
            state[:, j // 64] |= U(1) << U(j % 64)
        ends = -lengths
        for t in range(int(lengths[0]) if len(lengths) else 0):
            live = int(np.searchsorted(ends, -t, "left"))  # those longer than t
            c = buf[starts[:live] + t]
            s = state[:live]
            moved = s & self.move[c]
            stays = s & self.stay[c]
            state[:live] = (moved << U(1)) | stays
            state[:live, 1:] |= moved[:, :-1] >> U(63)
        win = np.full(len(order), -1)
        for i, places in enumerate(self.accept):
            hit = np.zeros(len(order), bool)
            for j in places:
                hit |= (state[:, j // 64] >> U(j % 64)) & U(1) > 0
            win[hit & (win < 0)] = i
        out = np.empty_like(win)
        out[order] = win
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; null or no ``://``: empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], own_rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, method_rule) of each page.

    ``rules`` are the given ones; where none fits, ``own_rules`` decide, else
    ``default``.  A url without a host is blocked as malformed unless a rule
    fits it.  Every row is kept, repeated rows too; other columns are left
    out.  Rule lists are parameters of a few thousand globs at most: their
    masks go into the task's closure.
    """
    d = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string, method_rule string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, own = Automaton(rules), Automaton(own_rules)
        for b in batches:
            hosts, paths = b.column(1), b.column(2)
            both = pa.compute.binary_join_element_wise(hosts, paths, "") if len(b) else hosts
            buf, offs = as_bytes(both)
            w, v = given.winners(buf, offs), own.winners(buf, offs)
            no_host = np.diff(as_bytes(hosts)[1]) == 0
            names = [given.rules[i].name if i >= 0 else None for i in w]
            method = [None if i >= 0 else "malformed" if e else own.rules[j].name if j >= 0 else "default" for i, j, e in zip(w, v, no_host)]
            verdict = [given.rules[i].verdict if i >= 0 else "block" if e else own.rules[j].verdict if j >= 0 else default for i, j, e in zip(w, v, no_host)]
            yield pa.RecordBatch.from_arrays([b.column(0), hosts, paths, pa.array(names, pa.string()), pa.array(verdict, pa.string()), pa.array(method, pa.string())], names=[key, "host", "path", "rule", "verdict", "method_rule"])

    return d.mapInArrow(run, schema)
