"""URL rules from a sorted digest array.

Rules are ``host + path`` strings. Their 64-bit xxhash keys are sorted and written with the strings to the shared folder;
workers memory-map them, probe all candidates of a batch of URLs by one binary search, and compare the stored string
wherever a key is found, so two strings with one key are told apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candex.llm.arrays import find_sorted, mapped, writing
from candex.plans.limits import pin, scratch_path

SEED = 42  # of Spark's xxhash64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _write(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Writes the rows of one partition, sorted by key, as four arrays."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    at = f"{path}/{shard:06d}"
    first, rows, lengths, labels = None, 0, set(), 0
    with writing(f"{at}.keys") as keys, writing(f"{at}.ends") as ends, writing(f"{at}.text") as text, writing(f"{at}.block") as block:
        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(0).to_numpy()
            strings = [s.encode() for s in batch.column(1).to_pylist()]
            stops = np.cumsum([len(s) for s in strings]) + total
            total = int(stops[-1])
            keys.write(found.tobytes())
            ends.write(stops.astype(np.int64).tobytes())
            text.write(b"".join(strings))
            block.write(batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
            lengths.update(batch.column(3).to_pylist())
            labels = max(labels, *batch.column(4).to_pylist())
            first = int(found[0]) if first is None else first
            rows += batch.num_rows
    if rows:
        yield pa.record_batch(
            [pa.array([shard]), pa.array([first], pa.int64()), pa.array([rows], pa.int64()), pa.array([sorted(lengths)], pa.list_(pa.int32())), pa.array([labels], pa.int32())],
            ["shard", "first", "rows", "lengths", "labels"],
        )


@dataclass(frozen=True)
class UrlRules:
    """Where a rule set's arrays are: the shards and their first keys, the lengths of paths and most labels of a host."""

    path: str
    shards: list[int]
    firsts: list[int]
    lengths: list[int]
    labels: int

    @staticmethod
    def build(rules: DataFrame, path: str | None = None, per_shard: int = 4_000_000) -> UrlRules:
        """Writes ``host, path, verdict`` (``allow`` or ``block``) as arrays; hosts are lower-cased.

        A rule with a null or empty host is left out, a null path is empty, a verdict that is null or not ``block``
        allows. If a rule comes with both verdicts it blocks.
        """
        spark = rules.sparkSession
        path = path or scratch_path(spark, "urls")
        host = F.translate(F.col("host"), _UPPER, _LOWER)
        place = F.coalesce(F.col("path"), F.lit(""))
        rows = rules.where("host <> ''").select(
            F.concat(host, place).alias("rule"), (F.coalesce(F.col("verdict"), F.lit("")) == "block").alias("block"),
            F.char_length(place).alias("length"), F.size(F.split(host, "[.]")).alias("labels"),
        )
        rows = rows.groupBy("rule").agg(F.bool_or("block").alias("block"), F.max("length").alias("length"), F.max("labels").alias("labels"))
        rows = pin(rows.select(F.xxhash64("rule").alias("key"), "rule", "block", "length", "labels"))
        shards = max(1, math.ceil(rows.count() / per_shard))
        written = rows.repartitionByRange(shards, "key").sortWithinPartitions("key", "rule").mapInArrow(
            partial(_write, path=path), "shard long, first long, rows long, lengths array<int>, labels int"
        )
        found = sorted(pin(written).collect())  # a row per shard
        return UrlRules(path, [r.shard for r in found], [r.first for r in found], sorted({n for r in found for n in r.lengths}), max([r.labels for r in found], default=0))


class _Probe:
    def __init__(self, rules: UrlRules):
        self.rules = rules
        at = [f"{rules.path}/{s:06d}" for s in rules.shards]
        self.firsts = np.array(rules.firsts, np.int64)
        self.keys = [mapped(f"{a}.keys", np.int64) for a in at]
        self.ends = [mapped(f"{a}.ends", np.int64) for a in at]
        self.text = [mapped(f"{a}.text", np.uint8) for a in at]
        self.block = [mapped(f"{a}.block", np.uint8) for a in at]

    def candidates(self, host: str, path: str) -> list[str]:
        """Strings of the rules that could fit, the longest first, of equal ones that with the longer host."""
        parts = host.split(".") if host else []
        hosts = [".".join(parts[i:]) for i in range(max(0, len(parts) - self.rules.labels), len(parts))]
        pairs = [(h, path[:n]) for h in hosts for n in self.rules.lengths if n <= len(path)]
        return [h + p for h, p in sorted(pairs, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]

    def lookup(self, strings: list[str]) -> list[bool | None]:
        """For each string whether the rule of that name blocks; None if there is none."""
        wanted = [s.encode() for s in strings]
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in wanted], np.uint64).view(np.int64)
        order = np.argsort(hashes, kind="stable")
        shard, place = find_sorted(hashes[order], self.firsts, self.keys)
        out: list[bool | None] = [None] * len(wanted)
        for i in np.flatnonzero(place >= 0):
            s, p, which = shard[i], place[i], order[i]
            while p < len(self.keys[s]) and self.keys[s][p] == hashes[which]:
                start = self.ends[s][p - 1] if p else 0
                if self.text[s][start : self.ends[s][p]].tobytes() == wanted[which]:
                    out[which] = bool(self.block[s][p])
                    break
                p += 1
        return out


def _judge(batches: Iterator[pa.RecordBatch], rules: UrlRules, default: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    probe = _Probe(rules)
    for batch in batches:
        hosts, paths = (batch.column(i).to_pylist() for i in (-2, -1))
        found = [probe.candidates(h, p) for h, p in zip(hosts, paths, strict=True)]
        strings = sorted({c for row in found for c in row})
        known = {s: b for s, b in zip(strings, probe.lookup(strings), strict=True) if b is not None}
        rule = [next((c for c in row if c in known), None) for row in found]
        verdict = [default if r is None else "block" if known[r] else "allow" for r in rule]
        yield pa.record_batch([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names)


def judge_urls(pages: DataFrame, rules: UrlRules, keep: list[str], url: str = "url", default: str = "allow") -> DataFrame:
    """The columns ``keep`` with ``host, path, rule, verdict`` for every row.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. The rule with most characters
    wins, of equal ones that with the longer host; without a rule the verdict is ``default``. A URL that is null or has
    no ``://`` has empty host and path and no rule. An empty table gives no rows; an empty rule set decides nothing.
    """
    rows = pages.select(*keep, url_host(url).alias("host"), url_path(url).alias("path"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [*keep, "host", "path", "rule", "verdict"]
    return rows.mapInArrow(partial(_judge, rules=rules, default=default, names=names), f"{schema}, rule string, verdict string")
