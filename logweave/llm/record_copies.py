"""Records that differ only in writing, collapsed by structural hashing.

Each record is read into a tree of fields.  Leaves are normalised (letter case, white space and punctuation removed) and
hashed; a node of named fields hashes its children's sorted (name, digest) pairs, so that field order doesn't count; a
list hashes its children's digests in order.  Records are grouped by the root digest, and the members of a group are
compared by the whole canonical structure.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import cut

_DROP = regex.compile(r"[^\p{L}\p{M}\p{N}\p{Sc}]+")
# a name may have any length; possessive, so that long texts without a mark are read once
_PAIR = regex.compile(r"""(?:^|[;,|&\n])[\s\[{(]*["']?([\p{L}_@][\w.@-]*+(?: ++[\w.@-]++)*+) *+["']?\s*+([=:])""")
_JSON = json.JSONDecoder(strict=False, parse_float=str, parse_int=str, object_pairs_hook=lambda pairs: _Fields(pairs))


class _Fields(list):
    """Named fields as (name, value) pairs, so that a name that stands twice isn't lost."""


def leaf(text) -> str:
    """A value without letter case, white space and punctuation."""
    text = "" if text is None else text if isinstance(text, str) else json.dumps(text)
    return _DROP.sub("", text.casefold())


def read_record(text: str):
    """The tree of a record: JSON, or ``name = value`` pairs parted by ; , | or &, or else the text itself."""
    bare = text.strip()
    if bare[:1] in "{[":
        try:
            tree = _JSON.decode(bare)
            if isinstance(tree, list):
                return tree
        except ValueError:
            pass
    found = list(_PAIR.finditer(text))
    if not found:
        return text
    # one record writes all its names with the same mark: a time's colons aren't names
    mark = found[0][2]
    found = [m for m in found if m[2] == mark]
    ends = [m.start() for m in found[1:]] + [len(text)]
    return _Fields((m[1], text[m.end() : e]) for m, e in zip(found, ends))


def fold(node) -> tuple[bytes, str]:
    """(digest, canonical structure) of a tree, bottom-up."""
    if isinstance(node, _Fields):
        children = sorted((leaf(name), *fold(value)) for name, value in node)
        body, canon = b"".join(n.encode() + b"\0" + d for n, d, _ in children), "{" + ",".join(f"{n}:{c}" for n, _, c in children) + "}"
        kind = b"F"
    elif isinstance(node, list):
        made = [fold(value) for value in node]
        body, canon, kind = b"".join(d for d, _ in made), "[" + ",".join(c for _, c in made) + "]", b"L"
    else:
        canon = leaf(node)
        body, kind = canon.encode(), b"V"
    return hashlib.blake2b(kind + body, digest_size=16).digest(), canon


def with_digest(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a struct column ``fold``: digest (16 bytes) and canon of each record."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([fold(read_record(t)) if t is not None else (None, None) for t in s.tolist()], columns=["digest", "canon"])

    return rows.withColumn("fold", F.pandas_udf(run, "digest binary, canon string").asNondeterministic()(F.col(text)))


def copies(records: DataFrame, ident: str, text: str, kind: str | None = None, hot_share: int = 1000, counted: bool = True) -> DataFrame:
    """One row a record: kind, ident, first_id (the smallest id of its group), copies (distinct ids in the group).

    Records are copies if they hold the same fields with the same values, apart from white space, letter case, punctuation and
    field order; only records of equal ``kind`` are compared.  Null texts and null ids are left out; empty texts are copies of
    one another; null kinds are a kind; repeated rows count once; an id with several texts stands in the group of each; an empty table gives no rows; further columns are ignored.  ``counted=False`` gives
    only the records that aren't the first of their group, without copies.

    The structures themselves are grouped with combination in the tasks, so that a structure moves once a task that holds it,
    however many records have it; records move as kind, id and digest.  Groups that hold more than 1/hot_share of all rows
    (so at most hot_share of them, of fixed size each) are joined by broadcast, the others by shuffle.
    """
    one = F.col(kind).cast("string") if kind else F.lit("")
    one = F.coalesce(F.concat(F.lit("="), one), F.lit(""))  # so that null is a kind like others in joins
    written = F.when(F.col("kind") != "", F.substring("kind", 2, 1 << 30)).alias("kind")
    rows = records.select(one.alias("kind"), F.col(ident).cast("long").alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    rows = cut(with_digest(rows, "t").select("kind", "id", F.col("fold.digest").alias("digest"), F.col("fold.canon").alias("canon")))
    # one row a structure: every member is compared with its group by the whole structure here
    forms = rows.groupBy("kind", "digest", "canon").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    heads = forms.groupBy("kind", "digest").agg(F.min("low").alias("first_id"), F.max("high").alias("high"), F.sum("n").alias("n"), F.count("*").alias("forms"))
    heads = cut(heads.where("first_id < high"))
    total = heads.agg(F.sum("n").alias("s"), F.max("forms").alias("f")).first()
    lone = heads.where("forms = 1").select("kind", "digest", "first_id", "n")
    hot = F.col("n") > F.lit(total["s"] or 0) / hot_share
    large, small = F.broadcast(lone.where(hot).drop("n")), lone.where(~hot).drop("n")
    narrow = rows.select("kind", "id", "digest")
    tied = narrow.join(large, ["kind", "digest"]).unionByName(narrow.join(large.drop("first_id"), ["kind", "digest"], "left_anti").join(small, ["kind", "digest"]))
    tied = tied.select("kind", "digest", "id", "first_id")
    if (total["f"] or 1) > 1:  # several structures under one digest: they are told apart by the structure
        odd = rows.join(heads.where("forms > 1").select("kind", "digest"), ["kind", "digest"], "left_semi")
        firsts = odd.groupBy("kind", "canon").agg(F.min("id").alias("first_id"))
        tied = tied.unionByName(odd.join(firsts, ["kind", "canon"]).select("kind", "digest", "id", "first_id"))
    if not counted:
        return tied.where("id > first_id").select("kind", "id", "first_id").distinct().select(written, "id", "first_id")
    tied = cut(tied.where("id > first_id").select("kind", "id", "first_id").distinct())
    sizes = tied.groupBy("kind", "first_id").agg((F.count("*") + 1).alias("copies"))
    many = F.col("copies") > F.lit(tied.count()) / hot_share
    few, most = sizes.where(~many), F.broadcast(sizes.where(many))
    keys = ["kind", "first_id"]
    others = tied.join(most, keys).unionByName(tied.join(most.drop("copies"), keys, "left_anti").join(few, keys)).select("kind", "id", "first_id", "copies")
    firsts = sizes.select("kind", F.col("first_id").alias("id"), "first_id", "copies")
    # a record is its own first unless it is tied to a smaller one or has copies
    known = tied.select("kind", "id").unionByName(firsts.select("kind", "id"))
    alone = rows.select("kind", "id").distinct().join(known, ["kind", "id"], "left_anti")
    alone = alone.select("kind", "id", F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return others.unionByName(firsts).unionByName(alone).select(written, "id", "first_id", "copies")
