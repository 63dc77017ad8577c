"""The typed object graph as tables, and relational work on them.

Kernels flatten one file at a time; everything else here is DataFrame work keyed by
document, so it shuffles ids and no file content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pdf
from ..functions.syntax import Name, Ref, Str, Stream, kind
from .tables import each_document, each_file

NODE = "obj_num long, gen int, node_id int, parent_id int, depth int, key string, ord int, kind string, v_bool boolean, v_int long, v_real double, v_bytes binary, str_format string, ref_num long, ref_gen int"


def _flat(num: int, gen: int, top):
    """Depth first, in the order of the file."""
    stack, n = [(top, None, 0, None, 0)], 0
    while stack:
        v, parent, depth, key, at = stack.pop()
        yield (
            num, gen, n, parent, depth, key, at, kind(v),
            v if isinstance(v, bool) else None,
            v if isinstance(v, int) and not isinstance(v, bool) else None,
            float(v) if kind(v) == "Real" else None,
            bytes(v) if isinstance(v, (Name, Str)) else None,
            ("hex" if v.hex else "literal") if isinstance(v, Str) else None,
            v.num if isinstance(v, Ref) else None,
            v.gen if isinstance(v, Ref) else None,
        )
        inner = v.dict if isinstance(v, Stream) else v
        if isinstance(inner, dict):
            stack += [(x, n, depth + 1, k, i) for i, (k, x) in reversed(list(enumerate(inner.items())))]
        elif isinstance(inner, list):
            stack += [(x, n, depth + 1, None, i) for i, x in reversed(list(enumerate(inner)))]
        n += 1


def nodes(files: DataFrame) -> DataFrame:
    """One row per value of every object; the trailer is object 0."""
    return each_document(files, NODE, lambda d: [row for r, v in [(Ref(0), d.trailer), *d.objects.items()] for row in _flat(r.num, r.gen, v)])


def xref_entries(files: DataFrame) -> DataFrame:
    """doc_id, obj_num, revision (0: newest), kind, offset, generation, container, idx."""

    def rows(content: bytes):
        content = content[max(0, content.find(b"%PDF-")) :]
        for k, table in enumerate(pdf.read_xref(content)[3]):
            for num, (what, a, b) in sorted(table.items()):
                yield (num, k, what, a, b, None, None) if what == "Normal" else (num, k, what, None, None, a, b)

    return each_file(files, "obj_num long, revision int, kind string, offset long, generation int, container long, idx int", rows)


def resolved(entries: DataFrame) -> DataFrame:
    """The newest entry of each object number; combined before the shuffle."""
    rest = [c for c in entries.columns if c not in ("doc_id", "obj_num", "revision")]
    best = entries.groupBy("doc_id", "obj_num").agg(F.min_by(F.struct(*rest), "revision").alias("_e"), F.min("revision").alias("revision"))
    return best.select("doc_id", "obj_num", "revision", "_e.*")


def dangling(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges to objects that their document doesn't have."""
    return edges.join(objects.select("doc_id", F.col("obj_num").alias("dst_num")), ["doc_id", "dst_num"], "left_anti")


def dangling_of(files: DataFrame) -> DataFrame:
    """``dangling`` of files that are at hand, found in each one: doc_id, dst_num, src_num, path."""

    def rows(d):
        own = {r.num for r in d.objects}
        return [(x.num, n, path) for n, v in [(0, d.trailer), *((r.num, v) for r, v in d.objects.items())] for path, x in pdf.references(v) if x.num not in own]

    return each_document(files, "dst_num long, src_num long, path string", rows)


def referrers(edges: DataFrame) -> DataFrame:
    """doc_id, dst_num, sources (how many objects point there), uses."""
    return edges.groupBy("doc_id", "dst_num").agg(F.countDistinct("src_num").alias("sources"), F.count(F.lit(1)).alias("uses"))


def overlay(base: DataFrame, delta: DataFrame, keys=("doc_id", "obj_num", "gen")) -> DataFrame:
    """An update over what was there: rows of ``delta`` replace those with their keys."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta.select(*base.columns))
