"""Command line: python -m factloom.cli <folder> [<folder>] | acct <folder> <mode> | call [term...] --folder F | npl [--year Y --quarter Q | --sheet F]."""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classify, deck, grid, lookup, matching, merged, profitability, summary
from .operators import tables as X
from .plans import dims
from .sinks import console, files, reports
from .sources import documents, regulator, workbooks

LANDING = "npl_cache"


def statement(docs: DataFrame, dictionary: DataFrame, name: str, period: int = 1) -> DataFrame:
    """Statement rows of a folder: lines of the statement's section, or of a whole file without one."""
    _, start, end = dims.STATEMENTS[name]
    lines = X.doc_lines(docs)
    inside = X.restrict_section(lines, F.array(*map(F.lit, start)), F.array(*map(F.lit, end)))
    outside = lines.join(inside.select(*X.KEY).distinct(), X.KEY, "left_anti")
    return lookup.statement_rows(X.code_entries(X.row_lines(inside.unionByName(outside))), dictionary, period)


def known(docs: DataFrame, bank: str | None, industry: str | None = None) -> DataFrame | None:
    """Identities of the folders with a bank or industry that the user names in place of what is detected; None when they name neither."""
    if bank is None and industry is None:
        return None
    found = classify.identity(docs)
    if bank is not None:
        found = found.withColumn("bank", F.lit(dims.resolve_bank(bank))).withColumn("industry", F.coalesce("industry", F.lit(dims.BANKING[0])))
    return found.withColumn("industry", F.lit(industry)) if industry is not None else found


def coding_path(docs: DataFrame, coding: list[str] | None, folder: str | None, industry: str | None) -> str:  # O-74
    """The coding workbook: the one given, else that in a folder of workbooks whose name has the industry given, else the industry detected."""
    if coding:
        if len(coding) > 1:
            raise ValueError("a statement needs one --coding")
        return coding[0]
    if not folder:
        raise ValueError("a statement needs --coding, or --coding-dir")
    named = industry or next((r.industry for r in classify.identity(docs).collect()), None)  # one folder
    fitting = sorted(n for n in os.listdir(folder) if named and named in n and n.lower().endswith(".xlsx"))
    if not fitting:
        raise ValueError(f"no coding workbook for industry {named!r} in {folder}; name one with --coding, or --industry one of {', '.join(n for n, _ in dims.INDUSTRY_WORDS)}")
    return f"file://{os.path.abspath(os.path.join(folder, fitting[0]))}"


def official(docs: DataFrame, landing: str, transport: regulator.Transport = regulator.fetch, banks: DataFrame | None = None) -> DataFrame:
    """The regulator's table for the decks of banks that it names."""
    named = (classify.identity(docs) if banks is None else banks).where(F.col("bank").isin(*dims.REGULATOR_NAMES)).select("folder")
    asked = named.join(deck.asked(docs), "folder", "left").select("year", "quarter").distinct().orderBy("year", "quarter")
    return regulator.for_quarters(docs.sparkSession, [tuple(r) for r in asked.collect()], landing, transport)  # as many as quarters


def statements(docs: DataFrame, uri: str, names: list[str], period: int) -> DataFrame:
    """Rows of the named statements with their section, by the coding workbook."""
    cells = workbooks.read_grid(docs.sparkSession, uri)
    full = grid.unmerged(cells.select("sheet", "r", "c", "value"), workbooks.read_grid(docs.sparkSession, uri, True)).persist()
    parts = [statement(docs, grid.coding_dictionary(full.where(F.col("sheet") == dims.STATEMENTS[n][0])), n, period).withColumn("section", F.lit(n)) for n in names]
    return reduce(DataFrame.unionByName, parts)


def warn_of_gaps(rows: DataFrame) -> None:
    """Names on stderr the folders of whose summary rows most are N/A."""
    for r in summary.coverage(rows).collect():
        print(f"WARNING: {r.missing} of {r.n} summary rows are N/A for {r.folder} - check that its layout is read correctly ({r.terms})", file=sys.stderr)


def sheets_of(out: DataFrame, first: str) -> list[tuple[str, list[tuple]]]:
    """A sheet for each folder; one, named after the first folder, for a merged pair."""
    columns = ("term", "value", "term_found", "page", "note", "is_percent", "is_scaled")
    by: dict[str, list[tuple]] = {}
    for r in out.toLocalIterator():  # a few rows for each of two folders
        by.setdefault(first if "place" in out.columns else r.folder, []).append(tuple(r[c] for c in columns))
    taken: set[str] = set()
    return [(files.sheet_name(f, taken), rows) for f, rows in by.items()]


def layout_codes(spark: SparkSession) -> DataFrame:
    """The codes of the summary's layout and composites, for folders without coding workbooks."""
    return spark.createDataFrame([(c,) for _, c, *_ in dims.LAYOUT if c] + [(c,) for f in dims.ENTITIES.values() for cs in f[2:] for c in cs], "code string")


def all_codes(spark: SparkSession, uris: list[str]) -> DataFrame:  # O-73
    """code: every code of the statements' sheets of all coding workbooks (files or folders of them)."""
    sheets = [s[0] for s in dims.STATEMENTS.values()]

    def read(merged_ranges: bool) -> DataFrame:
        every = reduce(DataFrame.unionByName, [workbooks.read_grid(spark, u, merged_ranges) for u in uris])
        return every.where(F.col("sheet").isin(sheets)).withColumn("sheet", F.concat_ws("/", "file", "sheet")).drop("file")

    return grid.coding_dictionary(grid.unmerged(read(False), read(True))).select("code").distinct()


def auto(docs: DataFrame, codes: DataFrame, landing: str = LANDING, transport: regulator.Transport = regulator.fetch) -> DataFrame:
    """Rows of all folders by kind; one filing and one deck are merged under one order.  Folders without rows are named on stderr."""
    found = classify.classified(docs, codes).collect()  # one row for each folder named on the command line
    by = {r.folder: r.kind for r in found}
    for r in found:
        if r.kind is None:
            print(f"skipped {r.folder}: not a filing or deck (coded rows: {r.code_hits}, files with deck wording: {r.con_hits})", file=sys.stderr)
    filing = docs.where(F.col("folder").isin([f for f, k in by.items() if (k or "").startswith("fin")]))
    talk = docs.where(F.col("folder").isin([f for f, k in by.items() if k == "con_call"]))
    for r in classify.identity(filing).collect():
        if r.bank is None or r.industry not in dims.BANKING:
            print(f"skipped {r.folder}: {r.message or f'no summary layout for industry {r.industry}'}", file=sys.stderr)
    pair = classify.paired(docs.sparkSession.createDataFrame(list(by.items()), "folder string, kind string")).first()
    ratios = None
    if pair:
        ratios = deck.deck_ratios(talk).withColumn("folder", F.lit(pair.filing))
    kinds = {"full": [f for f, k in by.items() if k == "fin_report"], "summarised": [f for f, k in by.items() if k == "fin_report_summary"]}
    filings = [summary.filing_summary(filing.where(F.col("folder").isin(fs)), kind, deck_ratios=ratios) for kind, fs in kinds.items() if fs or kind == "full"]
    told = reduce(DataFrame.unionByName, filings).persist()
    warn_of_gaps(told)
    left = merged.export_rows(told, True)
    right = merged.export_rows(deck.deck_summary(talk, official(talk, landing, transport)), False)
    if pair:
        return merged.merged(left, right).orderBy("place", "side", "pos")
    return left.unionByName(right).orderBy("folder", "pos")


def ratios(docs: DataFrame) -> DataFrame:
    lines = X.doc_lines(docs)
    rows = X.row_lines(lines)
    manual = profitability.manual_ratios(summary.manual_inputs(docs, X.code_entries(rows), rows, classify.identity(docs).select("folder", "bank")))
    return profitability.ratio_rows(profitability.entries(docs, lines), manual).orderBy("folder", "file_ord", "layout", "pos", "col")


def main(argv: list[str] | None = None, transport: regulator.Transport = regulator.fetch) -> None:
    p = argparse.ArgumentParser(prog="factloom")
    p.add_argument("what", nargs="+", help="folders, or: acct <folder> <balance_sheet|income_statement|cash_flow|all|summary|ratios>, call [term...], npl")
    p.add_argument("--folder")
    p.add_argument("--terms", help="term file (JSON)")
    p.add_argument("--coding", action="append", help="coding workbook; repeated for several, whose codes tell filings")
    p.add_argument("--coding-dir", help="folder of coding workbooks named after their industries")
    p.add_argument("--industry", choices=[n for n, _ in dims.INDUSTRY_WORDS], help="industry, in place of the one detected")
    p.add_argument("--bank", help="reporting bank, in place of the one detected")
    p.add_argument("--sheet", help="regulator workbook to show as it is, in place of the published figures")
    p.add_argument("--year", type=int, help="with --quarter: the quarter of the regulator's figures; the newest month without")
    p.add_argument("--quarter", type=int, choices=[1, 2, 3, 4])
    p.add_argument("--reports", help="folder for a report of each folder: workbooks, or CSV where the mode has no workbook")
    p.add_argument("--landing", default=LANDING, help="folder that keeps the regulator's files")
    p.add_argument("--period", type=int, default=1)
    p.add_argument("--csv", help="one CSV file; in automatic mode a folder, with one for each folder")
    p.add_argument("--excel", help="one workbook with a sheet for each folder")
    a = p.parse_args(argv)
    if a.period < 1:
        p.error("--period counts from 1")
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    kind = None
    if a.what[0] == "acct":
        docs, mode = documents.scan(spark, a.what[1]), a.what[2]
        if mode == "summary":
            out, kind = summary.filing_summary(docs, period=a.period, banks=known(docs, a.bank, a.industry)).orderBy("folder", "ord").persist(), "filing"
            warn_of_gaps(out)
        elif mode == "ratios":
            out = ratios(docs).persist()
            one = out.select("used_fallback").first()
            kind = "ratio_error" if one is None else "ratio_fallback" if one.used_fallback else "ratios"
        elif mode in dims.STATEMENTS or mode == "all":
            try:
                coding = coding_path(docs, a.coding, a.coding_dir, a.industry)
            except ValueError as e:
                p.error(str(e))
            rows = statements(docs, coding, list(dims.STATEMENTS) if mode == "all" else [mode], a.period)
            out, kind = rows.drop("section"), "statement"
            if mode == "all":
                order = F.when(F.col("section") == "ratios", len(dims.STATEMENTS)).otherwise(F.array_position(F.array(*map(F.lit, dims.STATEMENTS)), F.col("section")) - 1)
                out, kind = merged.combined(rows, ratios(docs)).orderBy("folder", order, "code", "file_ord", "pos", "col"), "combined"
        else:
            p.error(f"unknown mode {mode!r}; the statement of equity is not supported")
    elif a.what[0] == "call":
        docs, names = documents.scan(spark, a.folder), a.what[1:]
        terms = dims.load_terms(a.terms) if a.terms else dims.curated_terms()
        if names in ([], ["summary"]):
            banks = known(docs, a.bank)
            out, kind = deck.deck_summary(docs, official(docs, a.landing, transport, banks), banks).orderBy("folder", "ord"), "deck"
        else:
            unknown = [n for n in names if n not in terms]
            if unknown:
                raise KeyError(f"unknown terms: {unknown}")
            out, kind = matching.all_matches(X.doc_lines(docs), [terms[n] for n in names]), "matches"
    elif a.what[0] == "npl":
        if (a.year is None) != (a.quarter is None):
            p.error("--year and --quarter go together")
        out = workbooks.read_grid(spark, a.sheet) if a.sheet else regulator.for_quarters(spark, [(a.year, a.quarter)], a.landing, transport).orderBy("bank")
    else:
        once: dict[str, str] = {}
        for f in a.what:
            once.setdefault(os.path.realpath(f), f)
        folders = list(once.values())
        if len(folders) > 2:
            p.error("at most 2 folders")
        codes = all_codes(spark, a.coding) if a.coding else layout_codes(spark)
        docs = documents.scan(spark, *folders)
        there = {r.folder for r in docs.select("folder").distinct().collect()}
        for f in folders:
            if f.rstrip("/") not in there:
                print(f"skipped {f}: no .md file", file=sys.stderr)
        out = auto(docs, codes, a.landing, transport)
        out = out.persist()
        if a.excel:
            print(files.write_workbook(sheets_of(out, folders[0]), a.excel))
        each = out if "place" not in out.columns else out.withColumn("folder", F.lit(folders[0])).withColumn("pos", F.col("place") * 2 + F.col("side"))
        each = each.select("folder", "pos", *reports.WORKBOOK)
        if a.csv:
            reports.write_reports(each, uri(a.csv), "csv", ["pos"])
        if a.reports:
            reports.write_reports(each, uri(a.reports), "xlsx", ["pos"])
        if not (a.csv or a.excel or a.reports):
            show(out)
        return
    if a.csv and kind:
        files.write_report(kind, out, a.csv)
    if a.reports and kind:
        if kind.startswith("ratio_"):
            p.error("an approximated ratio table goes to --csv")
        reports.write_reports(files.with_folder(kind, out), uri(a.reports), "csv", [files.ORDER])
    if not (a.csv or a.reports):
        show(out)


def uri(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def show(out: DataFrame) -> None:
    """All rows as a table, lists as text."""
    flat = out.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in out.dtypes])
    for line in console.printed(flat):
        print(line)


if __name__ == "__main__":
    main()
