"""Finding deck terms in tables: a theta join of labels and terms, argmax with vetoes, and the most recent period.

Terms are a literal array exploded against each table, so a table meets each term in its own row and nothing is
shuffled until the best match of a folder is chosen.  Each decision is a named column, computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import multipattern as M
from ..functions import numeric as N
from ..functions import period as P
from ..functions import text as T
from ..sources.staged import staged
from . import tables as X



def strength(term: Column, text: Column) -> Column:  # O-83, O-108, O-131
    """0 vetoed or no match, 1 weighted components, 2 alias within the text, 3 alias is the text."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(T.strip(text))
    score = F.aggregate(F.transform(term.components, lambda c: F.when(T.contains_any(text, c.terms), c.weight).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return (
        F.when(T.contains_any(text, term.negatives), 0)
        .when(F.exists(term.aliases, lambda a: F.lower(a) == low), 3)
        .when(T.contains_any(text, term.aliases), 2)
        .when(term.composite & (F.size(term.components) > 0) & (score >= term.threshold), 1)
        .otherwise(0)
    )


def strengths(labels: DataFrame, terms: list) -> DataFrame:  # O-22, O-83, O-108, O-131
    """label, term, strength (1 to 3) for labels (label) and terms that match, as strength() has it: all wordings of all terms in one pass over each distinct label.

    A wording is a pattern of one automaton; what each says of its terms is a small table that the hits are joined with.
    """
    spark = labels.sparkSession
    uses: dict[str, list[tuple]] = {}
    for number, t in enumerate(terms):
        for role, words, part, weight in [("veto", t.negatives, 0, 0.0), ("alias", t.aliases, 0, 0.0), *[("part", w, k, x) for k, (w, x) in enumerate(t.components if t.composite else ())]]:
            for w in dict.fromkeys(map(str.lower, words)):
                uses.setdefault(w, []).append((number, role, part, float(weight)))
    empty = uses.pop("", [])  # an empty wording is in every label
    patterns = list(uses)
    known = spark.createDataFrame([(i, *u, len(w)) for i, w in enumerate(patterns) for u in uses[w]] + [(-1, *u, 0) for u in empty], "pattern int, number int, role string, part int, weight double, length int")
    facts = spark.createDataFrame([(i, t.name, t.threshold) for i, t in enumerate(terms)], "number int, term string, threshold double")
    text = F.lower(F.coalesce("label", F.lit("")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # asked for by number, as labels are small for the work that they make
    each = labels.select("label").repartition(tasks, "label").distinct().select("label", F.length(T.strip(text)).alias("chars"), F.concat(F.array(F.lit(-1)), M.found(text, M.automaton(patterns))).alias("hits"))
    hits = each.select("label", "chars", F.explode("hits").alias("pattern")).join(F.broadcast(known), "pattern")  # as many rows as the terms have wordings
    role = lambda r, c=F.lit(True): F.max((F.col("role") == r) & c)
    parts = F.array_sort(F.collect_set(F.when(F.col("role") == "part", F.struct("part", "weight"))))
    by = hits.groupBy("label", "number").agg(role("veto").alias("veto"), role("alias").alias("alias"), role("alias", F.col("length") == F.col("chars")).alias("whole"), parts.alias("parts"))
    x = by.join(F.broadcast(facts), "number")
    score = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p.weight)
    how = F.when(F.col("veto"), 0).when(F.col("whole"), 3).when(F.col("alias"), 2).when((F.size("parts") > 0) & (score >= F.col("threshold")), 1).otherwise(0)
    return x.select("label", "term", how.alias("strength")).where("strength > 0")


def entity_tier(entity: Column, primary: Column) -> Column:  # O-85
    """2 the reporting entity, 1 unnamed or neutral, 0 another company; primary: its names, null if unknown."""
    unknown = F.when(entity.contains("銀行"), 2).when(entity.contains("金控"), 0).otherwise(1)
    known = F.when(F.exists(primary, lambda a: entity.contains(a)), 2).when(T.names_company(entity), 0).otherwise(1)
    return F.when(F.coalesce(entity, F.lit("")) == "", 1).when(primary.isNull(), unknown).otherwise(known)


def with_orientation(tables: DataFrame) -> DataFrame:  # O-134
    """tables with period_col (periods down that column) or null, and by_column (periods across the header).

    Also header_periods and row_periods: what the cells of the header and the first three of each row say as periods,
    parsed once.
    """
    parsed = T.computed(
        tables, header_periods=F.transform("header", P.parse_period_label), row_periods=F.transform("rows", lambda r: F.transform(F.slice(r, 1, 3), P.parse_period_label))
    )

    rest = F.size(F.filter(F.slice("header", 2, 1 << 20), lambda c: c != ""))
    hits = F.size(F.filter(F.slice("header_periods", 2, 1 << 20), lambda p: p.isNotNull()))
    parsed = T.computed(parsed, header_votes=(hits > 0) & (2 * hits >= rest))

    def votes(col: int) -> Column:
        cells = F.size(F.filter("rows", lambda r: F.coalesce(F.get(r, F.lit(col)), F.lit("")) != ""))
        hits = F.size(F.filter("row_periods", lambda r: F.get(r, F.lit(col)).isNotNull()))
        # below a period of a header of periods stand figures, though some look like years
        figures = F.col("header_votes") & F.get("header_periods", F.lit(col)).isNotNull() if col else F.lit(False)
        return F.when((hits > 0) & (2 * hits >= cells) & ~figures, F.struct(hits.alias("hits"), F.lit(-col).alias("at")))

    best = F.array_max(F.array(*[votes(c) for c in range(3)]))
    voted = T.computed(parsed, period_col=-best["at"])
    return voted.withColumn("by_column", F.col("period_col").isNull() & F.col("header_votes")).drop("header_votes")


def candidates(tables: DataFrame, terms: Column, desired: str | None = None) -> DataFrame:  # O-84, O-86, O-109, O-135, O-145
    """A row for each table and term that match: term, value, matched_label, period_label, period_rank, strength, entity, is_percent.

    terms: array of struct(term, prefer_quarterly, require_absolute).
    """
    t = with_orientation(tables).where("period_col IS NOT NULL OR by_column")
    h0 = F.get("header", F.lit(0))
    own = F.when((F.coalesce(h0, F.lit("")) != "") & F.get("header_periods", F.lit(0)).isNull() & T.names_company(h0), h0)
    entity = F.coalesce(own, F.when(T.names_company(F.col("heading")), F.col("heading")))
    dated = lambda p, i, label: F.struct(p.alias("period"), i.alias("pos"), label.alias("label"))
    header_periods = F.filter(F.transform("header_periods", lambda p, i: dated(p, i, F.get("header", i))), lambda x: x.period.isNotNull() & (x.pos > 0))
    down = F.transform("row_periods", lambda r, i: dated(F.get(r, F.col("period_col")), i, F.get(F.get("rows", i), F.col("period_col"))))
    row_periods = F.filter(down, lambda x: x.period.isNotNull())
    periods = F.when(F.col("by_column"), header_periods).otherwise(row_periods)
    if desired is not None:
        periods = F.filter(periods, lambda x: x.label == desired)
    t = T.computed(t, entity=entity, periods=periods).where(F.size("periods") > 0)
    sections = X.row_sections(F.col("rows"))
    t = T.computed(t, labels=F.when(F.col("by_column"), F.transform(F.arrays_zip(F.col("rows"), sections.alias("section")), lambda x, i: F.struct(F.get(x.rows, F.lit(0)).alias("label"), i.alias("pos"), x.section.alias("section"), F.forall(F.slice(x.rows, 2, 1 << 20), lambda c: c == "").alias("bare")))).otherwise(
        F.filter(F.transform("header", lambda c, i: F.struct(c.alias("label"), i.cast("int").alias("pos"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("bare"))), lambda x: x.pos != F.col("period_col"))
    ))
    x = t.withColumn("want", F.explode(terms)).select("*", "want.*").drop("want")
    term = F.col("term")
    x = x.where(~T.contains_any(F.coalesce("heading", F.lit("")), term.negatives))
    scored = F.transform("labels", lambda c: F.struct(strength(term, c.label).alias("s"), c.label.alias("label"), c.pos.alias("pos"), c.section.alias("section"), T.is_share_or_growth(c.label).alias("share")))
    hit = F.filter(scored, lambda c: (c.s > 0) & ~T.contains_any(F.coalesce(c.section, F.lit("")), term.negatives))
    x = T.computed(x, hits=hit)
    whole = F.filter("hits", lambda c: ~c.share)
    # by row: share columns go where absolutes are required, else when another is left; by column: only where absolutes are required and one is left
    kept = F.when(F.col("by_column"), F.when(F.col("require_absolute") & (F.size(whole) > 0), whole).otherwise(F.col("hits"))).otherwise(
        F.when(F.col("require_absolute") | (F.size(whole) > 0), whole).otherwise(F.col("hits"))
    )
    best = F.array_min(F.transform(kept, lambda c: F.struct((-c.s).alias("s"), F.length(c.label).alias("n"), c.pos.alias("pos"), c.label.alias("label"))))
    x = T.computed(x, best=best)
    # without a candidate the heading may name the term, if one value column or row is left
    lone = F.filter("labels", lambda c: (c.label != "") & ~c.bare & ~T.is_share_or_growth(c.label))
    head_strength = F.when(F.col("heading").isNotNull(), strength(term, F.col("topic"))).otherwise(0)
    by_head = F.when(F.col("best").isNull() & (F.size(lone) == 1) & (head_strength > 0), F.struct(head_strength.alias("s"), F.get(lone, F.lit(0)).getField("pos").alias("pos"), F.col("topic").alias("label")))
    named = F.when(F.col("best").isNotNull(), F.struct((-F.col("best.s")).alias("s"), F.col("best.pos").alias("pos"), F.col("best.label").alias("label")))
    x = T.computed(x, pick=F.coalesce(named, by_head)).where("pick IS NOT NULL")

    def cell(p: Column) -> Column:
        row, col = F.when(F.col("by_column"), F.col("pick.pos")).otherwise(p.pos), F.when(F.col("by_column"), p.pos).otherwise(F.col("pick.pos"))
        return F.get(F.get("rows", row), col)

    x = T.computed(x, cellsp=F.transform(P.ranked(F.col("periods"), F.col("prefer_quarterly")), lambda p: F.struct(p.period.alias("period"), p.label.alias("label"), cell(p).alias("cell"))))
    usable = F.filter("cellsp", lambda c: c.cell.isNotNull() & ~(F.col("require_absolute") & T.is_percent_cell(c.cell)) & N.parse_numeric(c.cell).isNotNull())
    x = T.computed(x, found=F.get(usable, F.lit(0))).where("found IS NOT NULL")
    return x.select(
        "folder", "file_ord", "file_name", "header_line", F.col("term.name").alias("term"), "prefer_quarterly", N.parse_numeric(F.col("found.cell")).alias("value"), F.col("pick.label").alias("matched_label"),
        F.col("found.label").alias("period_label"), F.col("found.period.rank").alias("period_rank"), F.col("pick.s").alias("strength"), "entity", T.is_percent_cell(F.col("found.cell")).alias("is_percent"), "scale",
    )


def wanted(terms, prefer_quarterly: bool = False, require_absolute: bool = False) -> Column:
    from ..plans.dims import term_column

    flags = lambda t: F.struct(t.alias("term"), F.lit(prefer_quarterly).alias("prefer_quarterly"), F.lit(require_absolute).alias("require_absolute"))
    return F.transform(term_column(list(terms)), flags)


def in_lines(lines: DataFrame, groups: list[tuple[list, bool, bool]], desired: str | None = None) -> DataFrame:
    """candidates of groups (terms, prefer_quarterly, require_absolute); terms of equal section markers share a pass over the lines."""
    sections: dict[tuple, list[Column]] = {}
    for terms, quarterly, absolute in groups:
        for key in dict.fromkeys((t.start, t.end) for t in terms):
            sections.setdefault(key, []).append(wanted([t for t in terms if (t.start, t.end) == key], quarterly, absolute))
    found = None
    for number, (start, end) in enumerate(sections):
        some = X.restrict_section(lines, F.array(*map(F.lit, start)), F.array(*map(F.lit, end)).cast("array<string>")) if start else lines
        if start:  # tables are numbered anew within the section, as headings before it are out of sight
            some = some.withColumn("line_no", F.row_number().over(Window.partitionBy(*X.KEY).orderBy("line_no")) - 1)
        one = X.tables(some).withColumn("section_no", F.lit(number))
        found = one if found is None else found.unionByName(one)
    # each table meets the terms of its section
    by_section = [F.concat(*columns) if len(columns) > 1 else columns[0] for columns in sections.values()]
    return candidates(staged(found, "tables"), F.get(F.array(*by_section), F.col("section_no")), desired)


def best(found: DataFrame, primary: DataFrame | None = None) -> DataFrame:  # O-110, O-146
    """The best match of each folder and term: strength, tier, quarterly bonus, then file and table order.  primary: folder, primary (names)."""
    x = found.join(primary, "folder", "left") if primary is not None else found.withColumn("primary", F.lit(None).cast("array<string>"))
    x = x.withColumn("tier", entity_tier(F.col("entity"), F.col("primary"))).where("tier > 0")
    bonus = F.when(F.col("prefer_quarterly") & (F.col("period_rank") < 5), 1).otherwise(0)
    order = Window.partitionBy("folder", "term").orderBy(F.desc("strength"), F.desc("tier"), bonus.desc(), "file_ord", "header_line")
    return x.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n", "primary")


def all_matches(lines: DataFrame, terms: list) -> DataFrame:  # O-111
    return in_lines(lines, [(terms, False, False)])
