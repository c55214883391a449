"""The search: predicates, gate, score, explanations, total order and keyset pages over docs and their dictionary.

A doc matches by its fields' values, so gate and match are worked out once for each distinct value (`values_for`).
`search` joins them to the docs, as one lazy plan at any size. `SearchIndex.page` is the interactive path: while
few values matter it takes them as sets, and one pass over the docs gives the page, its place and the total.
"""

from __future__ import annotations

import base64
import json
import math
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.text import instant, norm_text, segment_grams, window, within_one
from inkstone.plans.docs import field_dictionary
from inkstone.schema import FIELD_LABELS, FIELDS, KIND_LABELS, WEIGHTS

#: Values that matter for a query that the interactive path takes as sets, at most; with more it joins.
FEW_VALUES = 20_000
#: A dictionary of at most so many values is held by the interactive path; of a larger one each query reads what matters.
HELD_VALUES = 200_000
#: Names of kinds, and the words of an explanation.
_KIND_NAMES = {
    "rubbing": "rubbing", "rubbings": "rubbing", "拓片": "rubbing", "damage": "damage", "damages": "damage", "缺损项": "damage",
    "batch": "batch", "batches": "batch", "批次": "batch", "修补批次": "batch",
}
_LEAD, _FREE_LEAD, _FREE_NEAR = "命中", "关键词命中", "关键词近似命中"
_APART = ("（与「", "」相差 1 字，已按错一个字容错）")
ORDER = (F.desc, "score"), (F.asc, "createdAt"), (F.asc, "code"), (F.asc, "id"), (F.asc, "kind")


def parse_kinds(value) -> list[str] | None:
    """Kinds by name, plural or label; unknown names are ignored, none known means no filter."""
    if not value:
        return None
    parts = value if isinstance(value, (list, tuple, set)) else str(value).split(",")
    return sorted({_KIND_NAMES[k] for p in parts if (k := str(p).strip().lower()) in _KIND_NAMES}) or None


def parse_instant(value: str | None) -> datetime | None:
    """An ISO date or date-time bound; without a zone it is UTC. Anything else raises ValueError."""
    if value in (None, ""):
        return None
    t = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def clamp_page_size(value) -> int:
    """1 to 100; 20 for what is no number or below 1."""
    try:
        v = float(value)
    except (TypeError, ValueError):
        return 20
    return min(100, math.floor(v)) if math.isfinite(v) and v >= 1 else 20


@dataclass(frozen=True)
class SearchQuery:
    q: str = ""
    code: str = ""
    source: str = ""
    damageType: str = ""
    kind: str | None = None
    dateFrom: str | None = None
    dateTo: str | None = None

    @staticmethod
    def from_params(p: dict) -> SearchQuery:
        first = lambda *names: next((p[n] for n in names if p.get(n)), "")
        return SearchQuery(
            first("q", "query", "keyword", "qText"), first("code"), first("source"), first("damageType", "type"),
            first("kind") or None, first("dateFrom", "from") or None, first("dateTo", "to") or None,
        )

    def fields(self) -> list[tuple[str, str]]:
        return [(f, v) for f in ("code", "source", "damageType") if (v := getattr(self, f)) and v.strip()]


def values_for(dictionary: DataFrame, q: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, raw, bonus, distance, window, hits) of the values that matter for a normalised query.

    bonus is null where the value does not match; hits are the numbers of the segments that it has a gram of.
    """
    n = F.col("norm")
    hits = [F.when(F.arrays_overlap("grams", F.array(*map(F.lit, grams))), F.lit(i)) for i, grams in enumerate(segment_grams(q))]
    out = dictionary.where(F.col("field").isin(list(fields))).select(
        "field",
        "raw",
        F.when(n == q, 20).when(n.contains(q), 8).alias("exact"),
        (F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")).alias("hits"),
        F.when(~n.contains(q), window(n, q)).alias("near"),
    )
    return out.where("exact IS NOT NULL OR near IS NOT NULL OR size(hits) > 0").select(
        "field",
        "raw",
        F.coalesce("exact", F.when(F.col("near").isNotNull(), -10)).alias("bonus"),
        F.when(F.col("exact").isNotNull(), 0).otherwise(1).alias("distance"),
        F.coalesce(F.when(F.col("exact").isNotNull(), q), F.col("near")).alias("window"),
        "hits",
    )


def _reason(m: Column, raw: str, lead: str, near: str, label: Column) -> Column:
    apart = F.concat(F.lit(near), label, F.lit(_APART[0]), m["window"], F.lit(_APART[1]))
    return F.struct(
        label.alias("field"), F.lit(raw).alias("query"), F.when(m["distance"] == 0, "exact").otherwise("fuzzy").alias("match"),
        m["distance"].alias("distance"), F.when(m["distance"] == 0, F.concat(F.lit(lead), label)).otherwise(apart).alias("detail"),
    )


def label_of(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(table, field), field)


def gated(docs: DataFrame, q: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Docs of which every segment of a normalised query has a gram in some field."""
    values = values_for(field_dictionary(docs) if dictionary is None else dictionary, q, FIELDS).where(F.size("hits") > 0)
    return _gate(_with_values(docs, values), q).drop(*[f"_v_{f}" for f in FIELDS])


def _with_values(docs: DataFrame, values: DataFrame) -> DataFrame:
    """docs with `_v_<field>`, the row of its own value of each field, null where that value does not matter.

    The five joins have the same right side (field and value are one key), so it is made and sent once.
    """
    key = lambda f, raw: F.concat_ws("\x01", f, raw)
    packed = values.select(key(F.col("field"), F.col("raw")).alias("_k"), F.struct("bonus", "distance", "window", "hits").alias("_v"))
    for f in FIELDS:
        own = packed.select("_k", F.col("_v").alias(f"_v_{f}"))
        docs = docs.join(own, key(F.lit(f), F.col(f)) == F.col("_k"), "left").drop("_k")
    return docs


def _gate(docs: DataFrame, q: str) -> DataFrame:
    nothing = F.array().cast("array<int>")
    seen = F.array_distinct(F.flatten(F.array(*[F.coalesce(f"_v_{f}.hits", nothing) for f in FIELDS])))
    return docs.where(F.size(seen) == len(segment_grams(q)))


def narrowed(docs: DataFrame, query: SearchQuery) -> DataFrame:
    """Docs of the kinds and in the range that a query asks for."""
    kinds = parse_kinds(query.kind)
    if kinds:
        docs = docs.where(F.col("kind").isin(kinds))
    lo, hi = parse_instant(query.dateFrom), parse_instant(query.dateTo)
    if lo is not None:
        docs = docs.where(instant(F.col("createdAt")) >= F.lit(lo))
    if hi is not None:
        docs = docs.where(instant(F.col("createdAt")) <= F.lit(hi))
    return docs


def search(docs: DataFrame, query: SearchQuery, dictionary: DataFrame | None = None) -> DataFrame:
    """Docs that match, with score and reasons (unordered; see `ordered`).

    Without a dictionary the distinct values of the fields that the query looks at are derived from the docs.
    """
    spark: SparkSession = docs.sparkSession
    out = narrowed(docs, query)
    source = out
    asked = [(f, raw, norm_text(spark, raw)) for f, raw in query.fields()]
    free = norm_text(spark, query.q)
    matches: list[tuple[str, str, str, str, Column]] = []
    for i, (field, raw, q) in enumerate(asked):
        values = values_for(field_dictionary(source, (field,)) if dictionary is None else dictionary, q, (field,))
        full = values.where((F.size("hits") == len(segment_grams(q))) & F.col("bonus").isNotNull())
        m = F.struct((F.col("bonus") + WEIGHTS[field] * 10).alias("score"), "distance", "window")
        out = out.join(full.select(F.col("raw").alias(f"_r{i}"), m.alias(f"_m{i}")), F.col(field) == F.col(f"_r{i}")).drop(f"_r{i}")
        matches.append((f"_m{i}", raw, _LEAD, _LEAD, F.lit(FIELD_LABELS[field])))
    if free:
        values = values_for(field_dictionary(source) if dictionary is None else dictionary, free, FIELDS)

        def scored(f: str) -> Column:
            v = F.col(f"_v_{f}")
            m = (v["bonus"] + WEIGHTS[f] * 10).alias("score"), F.lit(-FIELDS.index(f)).alias("ord"), F.lit(f).alias("field")
            return F.when(v["bonus"].isNotNull(), F.struct(*m, v["distance"].alias("distance"), v["window"].alias("window")))

        best = F.array_max(F.array_compact(F.array(*[scored(f) for f in FIELDS])))
        out = _gate(_with_values(out, values), free).withColumn("_free", best).where(F.col("_free").isNotNull())
        out = out.drop(*[f"_v_{f}" for f in FIELDS])
        matches.append(("_free", query.q, _FREE_LEAD, _FREE_NEAR, label_of(F.col("_free.field"))))
    score = sum((F.col(f"{m[0]}.score") for m in matches), F.lit(0))
    reasons = F.array(*[_reason(F.col(m), raw, lead, near, label) for m, raw, lead, near, label in matches])
    if not matches:
        reasons = reasons.cast("array<struct<field:string,query:string,match:string,distance:int,detail:string>>")
    return out.withColumns({"score": score, "matchedReasons": reasons}).drop(*[m[0] for m in matches])


def _in(field: str, values: list[str]) -> Column:
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"{field} IN ({quoted})") if values else F.lit(False)


def near_piece(n: str, q: str) -> str | None:
    """`window` of two strings."""
    half = len(q) // 2
    if len(q) < 2 or not (q[:half] in n or q[half:] in n):
        return None
    pieces = (n[i : i + size] for size in range(max(2, len(q) - 1), len(q) + 2) for i in range(len(n) - size + 1))
    return next((p for p in pieces if within_one(p, q)), None)


class HeldDictionary:
    """A small dictionary in memory, with the numbers of the values that have a gram."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.having: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for g in r["grams"]:
                self.having.setdefault(g, []).append(i)

    def values_for(self, q: str, fields: tuple[str, ...]) -> list[dict]:
        """As the function of this name, but for values that no matching doc can have.

        Those lack a segment that no value of another field asked for has.
        """
        hits: dict[int, list[int]] = {}
        of: list[set] = []
        for number, grams in enumerate(segment_grams(q)):
            found = {i for g in grams for i in self.having.get(g, ())}
            of.append({self.rows[i]["field"] for i in found} & set(fields))
            for i in found:
                hits.setdefault(i, []).append(number)
        alone = {f: [number for number, having in enumerate(of) if not having - {f}] for f in fields}
        half, out = len(q) // 2, []
        for i, r in enumerate(self.rows):
            n = r["norm"]
            if r["field"] not in fields or not (i in hits or q[:half] in n or q[half:] in n):
                continue
            if any(number not in hits.get(i, ()) for number in alone[r["field"]]):
                continue
            bonus = 20 if n == q else 8 if q in n else None
            piece = q if bonus else near_piece(n, q)
            if piece is not None or i in hits:
                known = bonus or (-10 if piece is not None else None)
                out.append({"field": r["field"], "raw": r["raw"], "bonus": known, "distance": 0 if bonus else 1, "window": piece, "hits": hits.get(i, [])})
        return out


class SearchIndex:
    """Docs and their dictionary (both kept by the caller: cached, or tables of a generation)."""

    def __init__(self, docs: DataFrame, dictionary: DataFrame):
        self.docs, self.dictionary = docs, dictionary
        self.spark = docs.sparkSession
        self._held: HeldDictionary | None = None
        self._counted = False

    def held(self) -> HeldDictionary | None:
        """The dictionary in memory, None if it is not a small one."""
        if not self._counted:
            self._counted = True
            if self.dictionary.count() <= HELD_VALUES:
                self._held = HeldDictionary(self.dictionary.select("field", "raw", "norm", "grams").toArrow().to_pylist())
        return self._held

    def search(self, query: SearchQuery) -> DataFrame:
        return search(self.docs, query, self.dictionary)

    def _conditions(self, query: SearchQuery) -> list[tuple] | None:
        """(query text, normal form, free?, {(field, raw): value row}) of each condition; None where more values matter than a driver takes."""
        asked = [(raw, norm_text(self.spark, raw), (f,)) for f, raw in query.fields()]
        free = norm_text(self.spark, query.q)
        asked += [(query.q, free, FIELDS)] if free else []
        out = []
        for raw, q, fields in asked:
            n, free_, held = len(segment_grams(q)), fields == FIELDS, self.held()
            if held is not None:
                rows = held.values_for(q, fields)
            else:
                rows = values_for(self.dictionary, q, fields).limit(FEW_VALUES + 1).toArrow().to_pylist()
            if not free_:
                rows = [r for r in rows if r["bonus"] is not None and len(r["hits"]) == n]
            if len(rows) > FEW_VALUES:
                return None
            if free_:
                rows = _useful(rows, n)
            out.append((raw, q, free_, {(r["field"], r["raw"]): r for r in rows}))
        return out

    def _scored(self, query: SearchQuery, conditions: list[tuple]) -> DataFrame:
        out, total = narrowed(self.docs, query), F.lit(0)
        for _, q, free, rows in conditions:
            scores = []
            for f in FIELDS:
                by: dict[int, list[str]] = {}
                for (field, raw), r in rows.items():
                    if field == f and r["bonus"] is not None:
                        by.setdefault(WEIGHTS[f] * 10 + r["bonus"], []).append(raw)
                one = F.lit(None).cast("int")
                for s in sorted(by):
                    one = F.when(_in(f, by[s]), F.lit(s)).otherwise(one)
                scores += [one] if by else []
            best = scores[0] if len(scores) == 1 else F.greatest(*scores) if scores else F.lit(None).cast("int")
            out = out.where(best.isNotNull())
            if free:
                full = {i for r in rows.values() if r["bonus"] is not None and len(r["hits"]) < len(segment_grams(q)) for i in range(len(segment_grams(q)))}
                for i in sorted(full):  # only where some matching value lacks a segment
                    has = [_in(f, [raw for (field, raw), r in rows.items() if field == f and i in r["hits"]]) for f in FIELDS]
                    out = out.where(has[0] | has[1] | has[2] | has[3] | has[4])
            total = total + best
        return out.withColumn("score", total)

    def page(self, query: SearchQuery, size: int, cursor: dict | None = None) -> tuple[list[dict], int, int]:
        """(rows of the page and one more, hits in all, hits before the page), in at most one job for each condition and one for the page."""
        conditions = self._conditions(query)
        hits = self.search(query) if conditions is None else self._scored(query, conditions)
        seen = Observation()
        before = F.count_if(~after(cursor)) if cursor else F.lit(0).cast("long")
        counted = hits.observe(seen, F.count(F.lit(1)).alias("n"), (before if cursor else F.max(before)).alias("before"))
        rows = [r.asDict(recursive=True) for r in page(counted, size, cursor).collect()]
        if conditions is not None:
            for r in rows:
                r["matchedReasons"] = [_explained(r, *c) for c in conditions]
        return rows, seen.get["n"], seen.get["before"] or 0


def _useful(rows: list[dict], n: int) -> list[dict]:
    """Without matching values whose missing segments no value of another field has."""
    having: dict[int, set] = {i: {r["field"] for r in rows if i in r["hits"]} for i in range(n)}
    rows = [r for r in rows if r["bonus"] is None or all(i in r["hits"] or having[i] - {r["field"]} for i in range(n))]
    if all(len(r["hits"]) == n for r in rows if r["bonus"] is not None):
        rows = [r for r in rows if r["bonus"] is not None]
    return rows


def _explained(row: dict, raw: str, q: str, free: bool, values: dict) -> dict:
    """The reason of one condition: that of the field that scores best, the earlier one of equals."""
    found = [(values[f, row[f]], f) for f in FIELDS if (f, row[f]) in values and values[f, row[f]]["bonus"] is not None]
    r, f = max(found, key=lambda x: (WEIGHTS[x[1]] * 10 + x[0]["bonus"], -FIELDS.index(x[1])))
    label, exact = FIELD_LABELS[f], r["distance"] == 0
    lead = _FREE_LEAD if free else _LEAD
    detail = lead + label if exact else f"{_FREE_NEAR if free else _LEAD}{label}{_APART[0]}{r['window']}{_APART[1]}"
    return {"field": label, "query": raw, "match": "exact" if exact else "fuzzy", "distance": r["distance"], "detail": detail}


def ordered(hits: DataFrame) -> DataFrame:
    """Score descending, then createdAt, code, id and kind ascending."""
    return hits.orderBy(*[f(c) for f, c in ORDER])


def present(hits: DataFrame) -> DataFrame:
    """Columns of a hit as it is shown."""
    kind = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
    parent = F.when(F.col("parent"), F.struct(F.col("rubbingId").alias("id"), "code", "source"))
    return hits.select(
        "kind", F.element_at(kind, F.col("kind")).alias("kindLabel"), "id", "code", "source", "damageType", "name", "createdAt",
        "score", "matchedReasons", parent.alias("rubbing"),
    )


def encode_cursor(row) -> str:
    tuple_ = {"s": row["score"], "t": row["createdAt"], "c": row["code"], "i": row["id"], "k": row["kind"]}
    return base64.urlsafe_b64encode(json.dumps(tuple_, ensure_ascii=False).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> dict | None:
    if not cursor:
        return None
    try:
        return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise ValueError("the page cursor cannot be read") from e


def after(cursor: dict) -> Column:
    """Rows strictly behind the cursor in the total order."""
    names = ("createdAt", "code", "id", "kind")
    mine = F.struct(*[F.col(c).cast("string").alias(c) for c in names])
    theirs = F.struct(*[F.lit(cursor[k]).cast("string").alias(c) for k, c in zip("tcik", names, strict=True)])
    return (F.col("score") < cursor["s"]) | ((F.col("score") == cursor["s"]) & (mine > theirs))


def page(hits: DataFrame, size: int, cursor: dict | None = None) -> DataFrame:
    """The next size + 1 rows in order (one more than the page, to know whether there are more)."""
    rest = hits.where(after(cursor)) if cursor else hits
    return ordered(rest).limit(size + 1)
