"""Regulator pages and files: verified HTTPS with an injectable transport, and a landing folder as the cache."""

from __future__ import annotations

import os
import ssl
import urllib.error
import urllib.request
import warnings
from collections.abc import Callable, Iterable
from typing import NamedTuple
from urllib.parse import unquote, urljoin

from pyspark.sql import DataFrame, SparkSession

from ..operators import grid
from ..plans import dims
from . import workbooks

Transport = Callable[[str, float], bytes]


class Dataset(NamedTuple):
    name: str
    page: str
    extension: str
    pattern: str  # year and month in a decoded file name
    bank_header: str
    headers: tuple[str, ...]


_SITE = "https://www.banking.gov.tw/ch/home.jsp"
# The regulator's pages, file names and headers.
CARD = Dataset(
    "循環信用餘額", f"{_SITE}?id=591&parentpath=0,590&mcustomize=multimessage_view.jsp&dataserno=21207&aplistdn=ou=disclosure,ou=multisite,ou=chinese,ou=ap_root,o=fsc,c=tw&dtable=Disclosure",
    "zip", r"(?i)^(\d{3})(\d{2})_[^/]*\.zip", "金融機構名稱", ("循環信用餘額",),
)
NPL = Dataset(
    "逾期放款總額", f"{_SITE}?id=590&parentpath=0&mcustomize=multimessage_view.jsp&dataserno=201202130001&dtable=Disclosure",
    "xlsx", r"(?i)(\d{3})_(\d{1,2})(?:\(\d+\))?\.xlsx", "銀行別", ("逾期放款總額", "逾放比率(%)", "備抵呆帳/逾期放款(%)"),
)
#: NPL amounts are in millions, revolving balances in thousands, ratios in percent.
TABLE = "bank string, year int, quarter int, card_period string, revolving double, npl_period string, overdue double, npl_ratio double, coverage double"
Quarter = tuple[int | None, int | None]


def fetch(url: str, timeout: float = 60.0) -> bytes:  # O-09
    """GET with a user agent; certificates are always verified."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout, context=ssl.create_default_context()) as r:
            return r.read()
    except urllib.error.URLError as e:
        raise RuntimeError(f"cannot fetch {url}: {e.reason}; if a proxy re-signs TLS, add its certificate to the system store") from e


def links(spark: SparkSession, page_url: str, extension: str, pattern: str, transport: Transport = fetch) -> DataFrame:  # O-10
    """y, m, url of a listing page; an error when it lists none."""
    page = spark.createDataFrame([(page_url, transport(page_url, 60.0).decode("utf-8", "ignore"))], "page_url string, html string")
    found = grid.period_links(page, extension, pattern)
    if found.isEmpty():
        raise RuntimeError(f"no {extension} link with a month on {page_url}")
    return found


def landed(url: str, folder: str, transport: Transport = fetch) -> str:  # O-11
    """Path of a file in the landing folder, fetched when it isn't there."""
    path = os.path.join(folder, unquote(url.rstrip("/").rpartition("/")[2]))
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        data = transport(url, 60.0)
        with open(path + ".part", "wb") as f:
            f.write(data)
        os.replace(path + ".part", path)
    return path


def figures(cells: DataFrame, bank_header: str, headers: list[str], banks: list[str]) -> DataFrame:  # O-167
    """bank and a column for each header, null where a bank isn't in the sheet."""
    spark = cells.sparkSession
    long = grid.columns_by_bank(cells, bank_header, spark.createDataFrame([(h,) for h in headers], "header string"), spark.createDataFrame([(b,) for b in banks], "bank string"))
    return long.groupBy("bank").pivot("header", headers).max("value")


def sheet_figures(spark: SparkSession, path: str, dataset: Dataset, banks: list[str]) -> dict[str, list[float | None]]:
    """The dataset's figures for each bank, from the first sheet of a landed file; an error where a header is missing."""
    with open(path, "rb") as f:
        found = list(workbooks.cells(f.read()))  # a row for each bank of the country; the landing folder is the driver's
    cells = spark.createDataFrame([x for x in found if x[0] == found[0][0]], "sheet string, r int, c int, value string")
    want = [dataset.bank_header, *dataset.headers]
    there = {r.header for r in grid.header_column(cells, spark.createDataFrame([(h,) for h in want], "header string")).collect()}
    if missing := [h for h in want if h not in there]:
        raise RuntimeError(f"no header {missing} in {path}; its layout may have changed")
    rows = figures(cells, dataset.bank_header, list(dataset.headers), banks).collect()
    return {r.bank: [r[h] for h in dataset.headers] for r in rows}


def published(spark: SparkSession, dataset: Dataset, asked: list[Quarter], banks: list[str], folder: str, transport: Transport = fetch) -> dict[Quarter, tuple[str, dict[str, list[float | None]]]]:  # O-167
    """Month used and figures by bank for each asked quarter, by the month that ends it; what can't be had is left out with a warning."""
    try:
        wanted = [(i, y and y - 1911, q and 3 * q) for i, (y, q) in enumerate(asked)]
        found = grid.resolve_period(links(spark, dataset.page, dataset.extension, dataset.pattern, transport), spark.createDataFrame(wanted, "id int, y int, m int")).collect()
    except Exception as e:
        warnings.warn(f"{dataset.name} is unavailable: {e}", stacklevel=2)
        return {}
    read, out = {}, {}
    for r in found:
        if r.url not in read:
            try:
                read[r.url] = sheet_figures(spark, landed(urljoin(dataset.page, r.url), folder, transport), dataset, banks)
            except Exception as e:
                read[r.url] = None
                warnings.warn(f"{dataset.name} of {r.y}年{r.m}月 is unavailable: {e}", stacklevel=2)
        if r.note:
            warnings.warn(f"{dataset.name}: {r.note}", stacklevel=2)
        if read[r.url]:
            out[asked[r.id]] = f"{r.y}年{r.m}月", read[r.url]
    return out


def for_quarters(spark: SparkSession, asked: Iterable[Quarter], folder: str, transport: Transport = fetch) -> DataFrame:  # O-167
    """The regulator's table for deck_summary: a row for each bank with a known name and asked (year, quarter), (None, None) for the newest month.

    Each dataset and file fails on its own: its figures are null then.
    """
    asked, banks = list(dict.fromkeys(asked)), list(dims.REGULATOR_NAMES.values())
    got = [(published(spark, d, asked, banks, folder, transport) if asked else {}, len(d.headers)) for d in (CARD, NPL)]
    rows = []
    for quarter in asked:
        for bank in banks:
            row = [bank, *quarter]
            for by_quarter, n in got:
                period, values = by_quarter.get(quarter, (None, {}))
                row += [period, *values.get(bank, [None] * n)]
            rows.append(tuple(row))
    return spark.createDataFrame(rows, TABLE)
