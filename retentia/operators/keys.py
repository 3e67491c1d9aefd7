"""All declared constraints of a set of tables in one shuffle, each table scanned once.

Every row of a table is turned into a few tagged entries: its primary key, each of
its foreign keys, and one entry per column check that it breaks. Entries of one key
*domain* meet: a domain is a table's primary key, and the foreign keys that point at
it are children of that domain. The union of all tables' entries is aggregated by
(domain, key), partially before the shuffle, so a key that holds a third of all rows
is one row of each task. What is left is one row per key with the number of its parent
rows and of its child rows per foreign key, which answers the null, duplicate and orphan
questions of all constraints at once.

Keys are compared as text, column by column (ids of one meaning have one text); a
NULL is a key value of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (child table, child column, parent table, parent column)
ForeignKey = tuple[str, str, str, str]


@dataclass
class _Domain:
    """A table's key columns, and the foreign keys that point at them."""

    number: int
    table: str
    keys: list[str]
    children: list[tuple[str, str]] = field(default_factory=list)


def column_checks(not_null=(), non_negative=(), between=(), max_length=()) -> dict[str, Column]:
    """Label -> whether a row breaks the check; NULL passes all but ``not_null``, as in SQL CHECK."""
    out = {f"not_null({c})": F.col(c).isNull() for c in not_null}
    out |= {f"non_negative({c})": F.col(c) < 0 for c in non_negative}
    out |= {f"between({c},{lo},{hi})": ~F.col(c).between(lo, hi) for c, lo, hi in between}
    return out | {f"max_length({c},{n})": F.length(F.col(c)) > n for c, n in max_length}


class KeyAudit:
    """The constraints of ``tables``, checked together.

    ``primary_keys`` and ``checks`` (label -> Column that is true for a broken row) go by
    table name; foreign keys whose tables are not given are left out. A foreign key may
    point at any column of its parent.
    """

    def __init__(self, tables: dict[str, DataFrame], primary_keys: dict[str, list[str]],
                 foreign_keys: list[ForeignKey], checks: dict[str, dict[str, Column]] | None = None):
        self.tables = tables
        self.checks = {t: c for t, c in (checks or {}).items() if t in tables}
        self.domains = [_Domain(k, t, keys) for k, (t, keys) in
                        enumerate((t, keys) for t, keys in primary_keys.items() if t in tables)]
        self.primary = {d.table: d for d in self.domains}
        self.foreign: dict[ForeignKey, tuple[_Domain, int]] = {}
        for fk in foreign_keys:
            child, ckey, parent, pkey = fk
            if child not in tables or parent not in tables:
                continue
            domain = next((d for d in self.domains if d.table == parent and d.keys == [pkey]), None)
            if domain is None:
                domain = _Domain(len(self.domains), parent, [pkey])
                self.domains.append(domain)
            domain.children.append((child, ckey))
            self.foreign[fk] = domain, len(domain.children)
        self.width = max((len(d.keys) for d in self.domains), default=1)
        self.tags = 1 + max((len(d.children) for d in self.domains), default=0)
        labels = [(t, label) for t, c in self.checks.items() for label in c]
        self.check_numbers = {x: len(self.domains) + k for k, x in enumerate(labels)}

    # ------------------------------------------------------------- one row to entries
    def _entry(self, domain: int, tag: int, keys: list[str]) -> Column:
        text = [F.col(k).cast("string") for k in keys] + [F.lit(None).cast("string")] * (self.width - len(keys))
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False))
        return F.struct(F.lit(domain).alias("domain"), F.lit(tag).alias("tag"), missing.alias("missing"),
                        *[c.alias(f"k{n}") for n, c in enumerate(text)])

    def _entries(self, table: str) -> list[Column]:
        out = []
        for d in self.domains:
            if d.table == table:
                out.append(self._entry(d.number, 0, d.keys))
            out += [self._entry(d.number, tag, [ckey]) for tag, (child, ckey) in enumerate(d.children, 1) if child == table]
        for label, broken in self.checks.get(table, {}).items():
            out.append(F.when(broken, self._entry(self.check_numbers[table, label], 0, [])))
        return out

    def per_key(self) -> DataFrame:
        """domain, the key, whether a part of it is NULL, and n0 (parent rows), n1 .. (child rows by foreign key)."""
        frames = [df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
                  for t, df in self.tables.items() if (entries := self._entries(t))]
        both = reduce(lambda a, b: a.unionAll(b), frames)
        counts = [F.count_if(F.col("tag") == t).alias(f"n{t}") for t in range(self.tags)]
        return both.groupBy("domain", "missing", *[f"k{n}" for n in range(self.width)]).agg(*counts)

    # ------------------------------------------------------------------- reports
    def _measures(self) -> DataFrame:
        """(domain, measure, n): one row per domain and measure."""
        n0, missing = F.col("n0"), F.col("missing")
        sums = {"rows": F.sum("n0"), "keys": F.count_if(n0 > 0), "null_keys": F.count_if((n0 > 0) & missing),
                "repeated": F.count_if((n0 > 1) & ~missing), "broken": F.count_if((n0 > 1) | (n0 > 0) & missing)}
        for t in range(1, self.tags):
            n = F.col(f"n{t}")
            sums[f"rows{t}"] = F.sum(n)
            sums[f"nulls{t}"] = F.sum(F.when(missing, n).otherwise(0))
            sums[f"orphans{t}"] = F.sum(F.when((n0 == 0) & ~missing, n).otherwise(0))
        wide = self.per_key().groupBy("domain").agg(*[F.coalesce(c, F.lit(0)).alias(m) for m, c in sums.items()])
        return wide.unpivot(["domain"], list(sums), "measure", "n")

    def _labelled(self, labels: list[tuple], schema: str) -> DataFrame:
        """``labels`` (domain, measure, ...) with their number; a domain without any entry has 0."""
        spark = next(iter(self.tables.values())).sparkSession
        # one row per declared constraint
        wanted = spark.createDataFrame(labels, f"domain int, measure string, {schema}")
        # as few measures: one row per domain and measure
        return (wanted.join(F.broadcast(self._measures()), ["domain", "measure"], "left")
                .withColumn("n", F.coalesce("n", F.lit(0))))

    def report(self) -> DataFrame:
        """(table_name, constraint, violations) of every constraint."""
        labels = [(n, "rows", t, label) for (t, label), n in self.check_numbers.items()]
        labels += [(d.number, "broken", t, f"primary_key({','.join(d.keys)})") for t, d in self.primary.items()]
        labels += [(d.number, f"orphans{tag}", child, f"foreign_key({ckey}->{parent}.{pkey})")
                   for (child, ckey, parent, pkey), (d, tag) in self.foreign.items()]
        return self._labelled(labels, "table_name string, constraint string").select(
            "table_name", "constraint", F.col("n").alias("violations"))

    def orphans(self) -> DataFrame:
        """(fk, orphans): child rows without a parent row; a NULL key has none, as in LEFT JOIN ... WHERE parent IS NULL."""
        labels = [(d.number, f"{m}{tag}", f"{child}.{ckey}")
                  for (child, ckey, _, _), (d, tag) in self.foreign.items() for m in ("orphans", "nulls")]
        return self._labelled(labels, "fk string").groupBy("fk").agg(F.sum("n").alias("orphans"))

    def keys(self) -> DataFrame:
        """(table_name, key, total_rows, distinct_keys, null_keys, repeated_keys) of every primary key."""
        labels = [(d.number, m, t, ",".join(d.keys)) for t, d in self.primary.items() for m in ("rows", "keys", "null_keys", "repeated")]
        found = self._labelled(labels, "table_name string, key string")
        one = {m: F.sum(F.when(F.col("measure") == m, F.col("n"))) for m in ("rows", "keys", "null_keys", "repeated")}
        return found.groupBy("table_name", "key").agg(
            one["rows"].alias("total_rows"), one["keys"].alias("distinct_keys"),
            one["null_keys"].alias("null_keys"), one["repeated"].alias("repeated_keys"))
