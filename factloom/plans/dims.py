"""Small dimension tables: entities, layouts, labels, terms, formulas.

All are of fixed size, well under a thousand rows, so joins with them are broadcast.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What must equal the documents' own codes, names and wording.
BANKING = ("金融業", "金控業")
#: Industries in order of priority, with the legal-name endings that name them.
INDUSTRY_WORDS = (
    ("保險業", ("人壽保險股份有限公司", "產物保險股份有限公司", "人壽保險公司", "產物保險公司")),
    ("金控業", ("金融控股股份有限公司", "金融控股公司")),
    ("金融業", ("商業銀行股份有限公司", "商業銀行")),
)
#: name: (aliases, primary entities, 評價及已實現 codes, 其他非利息收益 codes)
ENTITIES = {
    "國泰": (("國泰",), ("國泰世華", "Cathay United"), ("49200", "49310", "49450", "49600"), ("49700", "49750", "49800")),
    "中信": (("中信", "中國信託"), ("中信銀", "中國信託商業銀行", "中國信託銀行", "CTBC Bank"), ("49200", "49310", "49450", "49600"), ("49700", "49750", "49800", "49815", "49899")),
    "北富銀": (("北富銀", "台北富邦銀行", "臺北富邦銀行", "台北富邦", "臺北富邦", "富邦"), ("台北富邦", "臺北富邦", "Taipei Fubon"), ("49200", "49310", "49450", "49600"), ("49700", "49750", "49800")),
    "玉山": (("玉山",), ("玉山銀", "E.SUN", "ESUN"), ("49200", "49310", "49600"), ("49700", "49750", "49899")),
    "兆豐": (("兆豐",), ("兆豐銀", "Mega International", "Mega Bank"), ("49200", "43100", "49450", "49600"), ("49700", "49750", "49800")),
    "台新": (("台新", "臺新"), ("台新銀", "臺新銀", "Taishin"), ("49200", "49310", "49450", "49600"), ("49700", "49750", "49800")),
    "新光": (("新光",), ("新光銀", "Shin Kong Bank"), ("49200", "49310", "49600"), ("49700", "49815", "49899")),
    "永豐": (("永豐",), ("永豐銀", "Bank SinoPac"), ("49200", "49310", "49450", "49600"), ("49700", "49750", "49800")),
    "第一": (("第一商業銀行", "第一銀行", "第一金"), ("第一銀", "First Commercial Bank"), ("49200", "43100", "43600", "49600"), ("45000", "49750", "49800")),
    "華南": (("華南",), ("華南銀", "Hua Nan"), ("49200", "49310", "49450", "49600"), ("49700", "47003", "49899")),
}
OVERRIDES = {"full": {"國泰": {"64000": "63000"}}, "summarised": {"國泰": {"64000": "61000"}}}
REGULATOR_NAMES = {"北富銀": "台北富邦商業銀行", "國泰": "國泰世華商業銀行", "玉山": "玉山商業銀行", "中信": "中國信託商業銀行"}
LABEL_FALLBACKS = {
    "10000": ("資產總計", "資產合計"), "4xxxx": ("淨收益", "淨收益合計"), "49010": ("利息淨收益合計", "利息淨收益"), "58400": ("營業費用合計",),
    "61001": ("稅前淨利", "繼續營業單位稅前淨利"), "64000": ("本期稅後淨利", "本期淨利", "本年度淨利"), "63000": ("本期稅後淨利", "本期淨利", "本年度淨利"),
    "30000": ("權益總計", "權益合計"), "20000": ("負債合計", "負債總計"),
}
DERIVATIONS = {"58400": ("58500", "59000", "59500")}
#: (kind, code, term, cost line)
LAYOUT = (
    ("code", "10000", "總資產", False), ("code", "4xxxx", "淨收益", False), ("code", "49010", "利息淨收益", False), ("code", "49100", "手續費淨收益", False),
    ("composite", None, "評價及已實現", False), ("composite", None, "其他非利息收益", False), ("code", "58400", "營業費用", True), ("code", "58500", "員工福利費用", True),
    ("code", "59000", "折舊及攤銷費用", True), ("code", "59500", "其他費用", True), ("code", "58200", "呆帳提存(收回)", True), ("code", "61001", "稅前淨利", False),
    ("code", "61003", "所得稅費用", True), ("code", "64000", "稅後淨利", False), ("label", None, "活存比", False),
)
DEPOSIT_LABELS = ("活期性存款比率", "活存性存款比率", "活存比")
STATEMENTS = {
    "balance_sheet": ("資產負債表", ("合併資產負債表", "資產負債表", "Balance Sheet", "BALANCE SHEET"), ("合併綜合損益表", "綜合損益表", "Income Statement")),
    "income_statement": ("綜合損益表", ("合併綜合損益表", "綜合損益表", "Income Statement", "Statement of Comprehensive Income"), ("合併現金流量表", "現金流量表", "Cash Flow", "CASH FLOW")),
    "cash_flow": ("現金流量表", ("合併現金流量表", "現金流量表", "Cash Flow Statement", "CASH FLOW"), ("合併權益變動表", "權益變動表", "Statement of Changes in Equity")),
}
DECK_WORDS = ("法說會", "法人說明會", "說明會", "說明簡報", "投資人簡報", "投資人關係", "法人電話會議")
MERGED_ORDER = (
    "總資產", "淨收益", "利息淨收益", "手續費淨收益", "評價及已實現", "其他非利息收益", "營業費用", "員工福利費用", "折舊及攤銷費用", "其他費用",
    "呆帳提存(收回)", "稅前淨利", "所得稅費用", "稅後淨利", "ROA", "ROE", "活存比", "CIR", "NIM", "存放利差", "放款均率", "存款均率", "逾放比率", "備抵呆帳/逾期放款",
    "企業放款", "房貸", "個人放款", "信用卡循環", "法說會放款餘額合計", "法說會外幣放款",
)
RATIO_TERMS = ("NIM", "放款均率", "存款均率", "存放利差")
BALANCE_TERMS = ("企業放款", "房貸", "個人放款", "信用卡循環", "法說會放款餘額合計", "法說會外幣放款")
HELPER_TERMS = ("其他放款", "政府放款", "信貸", "其他個人授信其他", "海外子行", "海外分行", "OBU_DBU", "個人擔保貸款", "小額信貸")
#: bank, out term, in term, coefficient
LOAN_FORMULAS = (
    ("北富銀", "企業放款", "企業放款", 1), ("北富銀", "企業放款", "政府放款", 1), ("北富銀", "個人放款", "信貸", 1), ("北富銀", "個人放款", "其他個人授信其他", 1),
    ("中信", "企業放款", "企業放款", 1), ("中信", "企業放款", "法說會外幣放款", 1), ("中信", "企業放款", "海外子行", -1), ("中信", "個人放款", "其他放款", 1),
    ("中信", "個人放款", "信用卡循環", -1), ("中信", "法說會放款餘額合計", "法說會放款餘額合計", 1), ("中信", "法說會放款餘額合計", "海外子行", -1),
    ("中信", "法說會外幣放款", "海外分行", 1), ("中信", "法說會外幣放款", "OBU_DBU", 1), ("玉山", "房貸", "房貸", 1), ("玉山", "房貸", "個人擔保貸款", 1),
    ("玉山", "個人放款", "小額信貸", 1), ("玉山", "法說會放款餘額合計", "企業放款", 1), ("玉山", "法說會放款餘額合計", "房貸", 1),
    ("玉山", "法說會放款餘額合計", "個人擔保貸款", 1), ("玉山", "法說會放款餘額合計", "小額信貸", 1), ("玉山", "法說會放款餘額合計", "信用卡循環", 1),
)
LOAN_PARTS = ("企業放款", "房貸", "個人放款", "信用卡循環")
LOAN_TOLERANCE = 2.5
#: The terms that the deck summary and the ROA/ROE lookup need, in the shape of the term file.
TERMS = {
    "NIM": {"type": "exact", "aliases": ["淨利息收益率", "淨息差", "淨利差", "淨利息邊際", "NIM", "Net Interest Margin"]},
    "放款均率": {"type": "composite", "aliases": ["放款均率", "放款平均利率", "放款利率", "單季放款利率", "放款收益率"], "negative_terms": ["台幣", "臺幣", "外幣", "新台幣", "新臺幣"], "components": [{"terms": ["放款", "貸款", "授信", "Loan", "Loans", "Lending"], "weight": 0.5}, {"terms": ["均率", "平均利率", "收益率", "殖利率", "Yield", "Average Rate", "Rate"], "weight": 0.5}]},
    "存款均率": {"type": "composite", "aliases": ["存款均率", "存款平均利率", "存款利率", "單季存款利率", "存款成本率"], "negative_terms": ["台幣", "臺幣", "外幣", "新台幣", "新臺幣"], "components": [{"terms": ["存款", "存", "Deposit", "Deposits"], "weight": 0.5}, {"terms": ["均率", "平均利率", "成本率", "付息率", "資金成本", "Cost of Deposits", "Average Rate"], "weight": 0.5}]},
    "存放利差": {"type": "exact", "aliases": ["存放利差", "單季存放利差", "整體利差", "Spread"], "negative_terms": ["台幣", "臺幣", "外幣", "新台幣", "新臺幣"]},
    "企業放款": {"type": "composite", "aliases": ["企業放款"], "components": [{"terms": ["企業", "法人", "公司戶", "商業", "企金", "Corporate", "Commercial", "Business"], "weight": 0.6}, {"terms": ["放款", "貸款", "授信", "融資", "Loans", "Lending", "Credit"], "weight": 0.4}], "negative_terms": ["合併基礎"]},
    "房貸": {"type": "exact", "aliases": ["房貸", "房屋貸款", "住宅貸款", "購屋貸款", "房屋融資", "住宅抵押貸款", "不動產擔保放款", "Mortgage", "Housing Loan", "Home Loan", "Residential Mortgage"], "negative_terms": ["合併基礎"]},
    "個人放款": {"type": "composite", "aliases": ["個人放款"], "components": [{"terms": ["個人", "消費者", "消費性", "消費金融", "零售", "消金", "Consumer", "Retail", "Personal"], "weight": 0.6}, {"terms": ["放款", "貸款", "授信", "Loans", "Lending"], "weight": 0.4}]},
    "信用卡循環": {"type": "composite", "aliases": ["信用卡循環", "信用卡循環信用餘額", "信用卡循環額", "信用卡循環餘額"], "components": [{"terms": ["信用卡", "卡", "Credit Card", "Card"], "weight": 0.55}, {"terms": ["循環", "循環信用", "循環餘額", "應收帳款", "Revolving", "Revolving Credit", "Revolving Balance"], "weight": 0.45}]},
    "法說會放款餘額合計": {"type": "composite", "aliases": ["法說會放款餘額合計", "放款餘額合計", "總放款"], "components": [{"terms": ["放款", "貸款", "授信", "Loans", "Loan", "Lending"], "weight": 0.45}, {"terms": ["餘額", "總額", "Balance", "Balances", "Outstanding"], "weight": 0.3}, {"terms": ["合計", "總", "總計", "Total", "Gross"], "weight": 0.25}], "negative_terms": ["合併基礎"]},
    "法說會外幣放款": {"type": "composite", "aliases": ["法說會外幣放款", "外幣放款"], "components": [{"terms": ["外幣", "外匯", "外幣別", "Foreign Currency", "FC", "FX"], "weight": 0.55}, {"terms": ["放款", "貸款", "授信", "餘額", "Loans", "Loan", "Lending"], "weight": 0.45}], "negative_terms": ["合併基礎"]},
    "其他放款": {"type": "composite", "aliases": ["其他放款"], "components": [{"terms": ["放款", "貸款", "授信", "Loans", "Lending"], "weight": 0.5}, {"terms": ["其他", "Other", "Others"], "weight": 0.5}], "negative_terms": ["合併基礎"]},
    "政府放款": {"type": "exact", "aliases": ["政府"], "search_start": ["授信餘額組成"]},
    "信貸": {"type": "exact", "aliases": ["信貸"], "search_start": ["其他個人授信餘額"]},
    "其他個人授信其他": {"type": "exact", "aliases": ["其他"], "search_start": ["其他個人授信餘額"]},
    "海外子行": {"type": "exact", "aliases": ["海外子行"], "search_start": ["外幣放款成長率"]},
    "海外分行": {"type": "exact", "aliases": ["海外分行"], "search_start": ["外幣放款成長率"]},
    "OBU_DBU": {"type": "exact", "aliases": ["OBU+DBU"], "search_start": ["外幣放款成長率"]},
    "個人擔保貸款": {"type": "exact", "aliases": ["個人擔保貸款", "個人擔保放款", "Secured Personal Loans", "Secured Personal Loan"]},
    "小額信貸": {"type": "exact", "aliases": ["小額信貸", "個人信貸", "Small-amount Credit Loans", "Personal Credit Loans"]},
    "ROA(稅後年化)": {"type": "composite", "aliases": ["ROA(稅後年化)", "資產報酬率", "ROA"], "components": [{"terms": ["資產報酬率", "平均資產報酬率", "ROA", "Return on Assets", "Return on Average Assets"], "weight": 0.85}, {"terms": ["年化", "Annualized", "Annualised", "Ann."], "weight": 0.08}, {"terms": ["稅後", "After Tax", "Post-tax"], "weight": 0.07}], "negative_terms": ["權益", "Equity", "ROE"]},
    "ROE(稅後年化)": {"type": "composite", "aliases": ["ROE(稅後年化)", "股東權益報酬率", "ROE"], "components": [{"terms": ["股東權益報酬率", "權益報酬率", "ROE", "Return on Equity", "Return on Average Equity"], "weight": 0.85}, {"terms": ["年化", "Annualized", "Annualised", "Ann."], "weight": 0.08}, {"terms": ["稅後", "After Tax", "Post-tax"], "weight": 0.07}], "negative_terms": ["資產報酬率", "Return on Assets", "ROA"]},
}
# End of fixed values.

TERM_TYPE = "array<struct<name:string,composite:boolean,aliases:array<string>,components:array<struct<terms:array<string>,weight:double>>,threshold:double,negatives:array<string>,start:array<string>,end:array<string>>>"


@dataclass(frozen=True)
class Term:
    name: str
    composite: bool = False
    aliases: tuple[str, ...] = ()
    components: tuple[tuple[tuple[str, ...], float], ...] = ()
    threshold: float = 0.8
    negatives: tuple[str, ...] = ()
    start: tuple[str, ...] = ()
    end: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, name: str, spec: dict) -> Term:  # O-169
        """Checks a term of the term file; errors name the term."""
        aliases = spec.get("aliases", [])
        if not isinstance(aliases, list) or any(not isinstance(a, str) or not a.strip() for a in aliases):
            raise ValueError(f"term {name!r}: blank or malformed alias")
        parts = []
        for c in spec.get("components", []):
            if not isinstance(c, dict) or set(c) - {"terms", "weight"} or not c.get("terms") or not isinstance(c.get("weight"), (int, float)):
                raise ValueError(f"term {name!r}: malformed component {c!r}")
            parts.append((tuple(c["terms"]), float(c["weight"])))
        kind = spec.get("type", "exact")
        if kind not in ("exact", "composite"):
            raise ValueError(f"term {name!r}: unknown type {kind!r}")
        lists = {k: tuple(spec.get(k) or ()) for k in ("negative_terms", "search_start", "search_end")}
        return cls(name, kind == "composite", tuple(aliases), tuple(parts), float(spec.get("threshold", 0.8)), lists["negative_terms"], lists["search_start"], lists["search_end"])


def load_terms(path: str) -> dict[str, Term]:  # O-07
    """Terms of a JSON file of the shape of TERMS; keys that start with _ are skipped."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    try:
        return {k: Term.of(k, v) for k, v in raw.items() if not k.startswith("_")}
    except (ValueError, AttributeError) as e:
        raise ValueError(f"{path}: {e}") from e


def curated_terms() -> dict[str, Term]:
    return {k: Term.of(k, v) for k, v in TERMS.items()}


def term_column(terms: list[Term]) -> Column:
    """Terms as a literal array of structs."""
    rows = [dict(name=t.name, composite=t.composite, aliases=t.aliases, components=[dict(terms=w, weight=x) for w, x in t.components], threshold=t.threshold, negatives=t.negatives, start=t.start, end=t.end) for t in terms]
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), TERM_TYPE)


def check_entities(entities: dict = ENTITIES, overrides: dict = OVERRIDES) -> None:  # O-169, O-156
    """Every entity has aliases, primary entities and both composites; overrides name entities."""
    for name, fields in entities.items():
        if len(fields) != 4 or any(not f for f in fields):
            raise ValueError(f"entity {name!r} is incomplete")
    unknown = {n for table in overrides.values() for n in table} - set(entities)
    if unknown:
        raise ValueError(f"overrides of unknown entities: {sorted(unknown)}")


check_entities()


def resolve_bank(name: str) -> str:  # O-114
    for bank, (aliases, *_) in ENTITIES.items():
        if name == bank or name in aliases:
            return bank
    raise ValueError(f"unknown bank {name!r}; choices: {', '.join(ENTITIES)}")


def layout(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, kind, code, term, cost) for i, (kind, code, term, cost) in enumerate(LAYOUT)]
    return spark.createDataFrame(rows, "ord int, kind string, slot string, term string, is_cost boolean")


def overrides(spark: SparkSession, kind: str = "full") -> DataFrame:
    rows = [(b, slot, code) for b, m in OVERRIDES[kind].items() for slot, code in m.items()]
    return spark.createDataFrame(rows, "bank string, slot string, new_code string")


def composites(spark: SparkSession) -> DataFrame:  # O-139
    rows = [(b, term, i, code) for b, (_, _, realised, other) in ENTITIES.items() for term, codes in (("評價及已實現", realised), ("其他非利息收益", other)) for i, code in enumerate(codes)]
    return spark.createDataFrame(rows, "bank string, term string, part int, code string")


def fallbacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(slot, label) for slot, labels in LABEL_FALLBACKS.items() for label in labels], "slot string, label string")


def derivations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(code, i, part) for code, parts in DERIVATIONS.items() for i, part in enumerate(parts)], "code string, part int, part_code string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i, a) for i, (b, f) in enumerate(ENTITIES.items()) for a in f[0]], "bank string, bank_ord int, alias string")


def loan_formulas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOAN_FORMULAS, "bank string, out_term string, in_term string, coef int")
