"""Text predicates of document retrieval: folding, keyword tags, windows, marks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword groups, matched as substrings of folded text.
KEYWORDS: dict[str, tuple[str, ...]] = {
    "financing": (
        "financing instruments", "cost and financing", "financing structure", "public and private financing",
        "parallel financing", "cofinancing", "co-financing", "counterpart", "currency", "loan currency",
        "united states dollars", "costo y financiamiento", "costos y financiamiento", "estructura de financiamiento",
        "cofinanciamiento", "cofinanciacion", "financiamiento paralelo", "aporte local", "contrapartida", "moneda",
        "custo e financiamento", "estrutura de financiamento", "cofinanciamento", "financiamento paralelo", "moeda",
    ),
    "procurement": (
        "procurement", "competitive bidding", "threshold amounts", "international competitive bidding",
        "national competitive bidding", "licitacion publica internacional", "licitacion publica nacional",
        "licitacao publica internacional", "licitacao publica nacional", "adquisiciones", "licitacion",
        "contrataciones", "contratacion directa", "aquisicoes", "licitacao", "contratacoes",
    ),
    "risks": (
        "other risks", "fiduciary risks", "environmental and social risks", "medium risk", "high risk",
        "risk classification", "mitigation action", "main risks", "riesgos de contexto", "riesgos fiduciarios",
        "riesgos especificos", "riesgos de capacidad", "principales riesgos", "mitigacion", "riscos fiduciarios",
        "principais riscos", "mitigacao",
    ),
    "execution": (
        "execution mechanism", "implementation arrangements", "executing agency", "mecanismo de ejecucion",
        "esquema de ejecucion", "organismo ejecutor", "unidad ejecutora", "agencia ejecutora",
        "mecanismo de execucao", "orgao executor", "unidade executora",
    ),
    "disbursement": (
        "disbursements", "disbursement schedule", "projected disbursements", "disbursement period",
        "periodo de desembolso", "plazo de desembolso", "desembolso",
    ),
    "safeguards": (
        "environmental and social considerations", "safeguard", "impact category", "environmental category",
        "classified as category", "category a", "category b", "category c", "clasificacion ambiental",
        "clasificado como categoria", "categoria a", "categoria b", "categoria c", "classificado como categoria",
        "salvaguardia", "salvaguarda", "ambiental y social", "socioambiental", "ambiental e social",
    ),
    "works": (
        "civil works", "construction works", "investment in infrastructure", "infrastructure investment",
        "inversion en infraestructura", "investimento em infraestrutura", "obras civiles",
        "obras de infraestructura", "construccion de", "obras civis", "construcao de",
    ),
    "execution_conditions": (
        "retroactive financing", "advance contracting", "advance procurement", "conditions precedent",
        "special conditions of execution", "financiamiento retroactivo", "contratacion anticipada",
        "adquisiciones anticipadas", "condiciones especiales de ejecucion", "condiciones contractuales especiales",
        "financiamento retroativo", "contratacao antecipada", "condicoes especiais de execucao",
    ),
    "cost_table": (
        "cost and financing", "project cost", "goods and services", "equipment and materials",
        "costo y financiamiento", "costo del proyecto", "adquisicion de bienes", "bienes y servicios",
        "equipamiento", "presupuesto por componente", "custo e financiamento", "aquisicao de bens",
        "bens e servicos", "projected disbursements", "disbursement schedule", "cronograma de desembolsos",
        "plan financiero", "cronograma de inversiones", "cronograma de desembolso",
    ),
    "eligibility": (
        "eligibility", "eligible for disbursement", "eligibility date",
        "conditions prior to the first disbursement", "first disbursement", "elegibilidad",
        "fecha de elegibilidad", "elegible para desembolso", "condiciones previas al primer desembolso",
        "primer desembolso", "elegibilidade", "data de elegibilidade", "primeiro desembolso",
    ),
    "price_adjustment": (
        "price adjustment", "price escalation", "price variation", "escalation clause", "price redetermination",
        "redeterminacion", "reajuste", "ajuste de precios", "variacion de precios", "formula polinomica",
        "formulas polinomicas", "formulas parametricas", "reajuste de precos", "ajuste de precos",
    ),
}
# What a file name says about its topic.
FILE_HINTS = {
    "safeguards": ("safeguard", "spf", "esmr", "esms", "igas", "ambiental", "environmental"),
    "procurement": ("procurement", "adquisicion", "aquisic", "fiduciar"),
    "disbursement": ("disbursement", "desembolso"),
    "financing": ("financial", "financier", "costo", "cost"),
    "works": ("economic analysis", "analisis economico", "cost benefit", "costo beneficio", "evaluacion economica", "analise economica"),
}
# Weights above 1, order of service, marks of a summary page.
WEIGHTS = {"price_adjustment": 3, "eligibility": 3, "execution_conditions": 3, "cost_table": 2, "works": 2}
TAG_ORDER = ("price_adjustment", "eligibility", "execution_conditions", "cost_table", "works", "disbursement", "safeguards", "procurement", "execution", "financing", "risks")
SUMMARY_MARKS = ("financial terms and conditions", "terminos y condiciones financieras", "termos e condicoes financeiras")
CONTENTS_LINE = r"(\.{5,}|…{2,}|_{5,})\s*\d"
MAX_PARAGRAPH, LEAD, SUMMARY_HEAD = 2500, 400, 800


#: White space as Python's strip() and splitlines() know it, as a class of characters
#: and as line ends.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def stripped(c: Column) -> Column:
    """Without white space at its ends, whatever its kind. Only a text whose last
    character is white space is searched for where its end begins."""
    first, last = F.substring(c, 1, 1).rlike(BLANK), F.substring(c, -1, 1).rlike(BLANK)
    bare = F.when(last, F.regexp_replace(c, rf"\A{BLANK}+|{BLANK}+\z", "")).when(first, F.regexp_replace(c, rf"\A{BLANK}+", ""))
    return bare.otherwise(c)


def fold(text: str) -> str:
    """Lower case, compatibility-decomposed, without combining marks."""
    low = text.lower()
    if low.isascii():
        return low
    low = unicodedata.normalize("NFKD", low)
    for c in set(low):
        if unicodedata.combining(c):
            low = low.replace(c, "")
    return low


#: Bytes of texts that are folded together; a longer text is folded by itself.
PIECE = 1 << 18
_NEW, _OTHER = 2**32 - 1, 2**32 - 2
#: What each character is folded to, learned when it is first met: folding looks at one
#: character at a time, but for the capital sigma, whose lower case depends on its place.
#: _SEVERAL has those that become several characters or none.
_ONE = np.full(0x110000, _NEW, np.uint32)
_ONE[:128] = [ord(chr(c).lower()) for c in range(128)]
_SEVERAL: dict[int, list[int]] = {}
_WORD = np.full(128, 32, np.uint8)
_WORD[ord("0") : ord("9") + 1] = range(ord("0"), ord("9") + 1)
_WORD[ord("a") : ord("z") + 1] = range(ord("a"), ord("z") + 1)


def _codes(raw: memoryview, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The folded characters of texts that lie end to end, and where each begins (and the
    last ends). None if a capital sigma is among them."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data) or data.max() < 128:
        return _ONE[data], at
    text = str(raw, "utf-8")
    if "\u03a3" in text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]
    out = _ONE[codes]
    for c in np.unique(codes[out == _NEW]).tolist():
        to = [ord(x) for x in fold(chr(c))]
        _ONE[c] = to[0] if len(to) == 1 else _OTHER
        if len(to) != 1:
            _SEVERAL[c] = to
    out = _ONE[codes]
    several = np.unique(codes[out == _OTHER]).tolist()
    if several:
        sizes = np.ones(len(codes), np.int64)
        for c in several:
            sizes[codes == c] = len(_SEVERAL[c])
        place = np.append(0, np.cumsum(sizes))
        out = np.repeat(out, sizes)
        for c in several:
            for k, x in enumerate(_SEVERAL[c]):
                out[place[:-1][codes == c] + k] = x
        at = place[at]
    return out, at


def _as_text(codes: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    if not len(codes) or codes.max() < 128:
        return codes.astype(np.uint8).tobytes(), at
    sizes = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    return codes.tobytes().decode("utf-32-le").encode(), np.append(0, np.cumsum(sizes))[at]


def _as_words(codes: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    letters = _WORD[np.minimum(codes, 127)]
    kept = letters != 32
    before = np.append(0, np.cumsum(kept))
    # A space stands for a gap between two words of one text: its last character.
    gap = np.flatnonzero(~kept[:-1] & kept[1:])
    row = np.searchsorted(at[1:], gap, "right")
    kept[gap[(gap + 1 < at[row + 1]) & (before[gap] > before[at[row]])]] = True
    return letters[kept].tobytes(), np.append(0, np.cumsum(kept))[at]


def _by_pieces(texts: pa.Array, finish: Callable[[np.ndarray, np.ndarray], tuple[bytes, np.ndarray]], plain: Callable[[str], str]) -> pa.Array:
    """Each text by finish, a piece of many texts at a time; by plain, where it has to be
    looked at by itself."""
    bare = pc.fill_null(texts.cast(pa.string()), "")
    n, (_, places, data) = len(bare), bare.buffers()
    at = np.frombuffer(places, np.int32)[bare.offset : bare.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw, done, sizes, i = memoryview(data if data is not None else b""), [], [], 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        found = _codes(raw[at[i] : at[j]], at[i : j + 1] - at[i]) if at[j] - at[i] <= PIECE else None
        if found is None:
            each = [plain(str(raw[at[k] : at[k + 1]], "utf-8")).encode() for k in range(i, j)]
            done.append(b"".join(each))
            sizes.append(np.array([len(x) for x in each], np.int64))
        else:
            out, ends = finish(*found)
            done.append(out)
            sizes.append(np.diff(ends))
        i = j
    ends = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
    out = pa.StringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(b"".join(done)))
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.string())) if texts.null_count else out


def _plain_words(text: str) -> str:
    return re.sub("[^a-z0-9]+", " ", fold(text)).strip(" ")


def _folded(texts: pa.Array) -> pa.Array:
    return _by_pieces(texts, _as_text, fold)


def _worded(texts: pa.Array) -> pa.Array:
    return _by_pieces(texts, _as_words, _plain_words)


def folded(c: Column) -> Column:
    """fold() as a column: an Arrow function, since Spark has no NFKD."""
    return F.arrow_udf(_folded, "string")(c)


def words_of(c: Column) -> Column:
    """Folded text with every run of other characters as one space, trimmed."""
    return F.arrow_udf(_worded, "string")(c)


def is_contents_line(c: Column) -> Column:
    """Few lines hold what the pattern begins with, and only these are matched with it."""
    leaders = F.contains(c, F.lit(".....")) | F.contains(c, F.lit("……")) | F.contains(c, F.lit("_____"))
    return F.coalesce(leaders & c.rlike(CONTENTS_LINE), F.lit(False))


def tag_hits(low: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    """Group -> number of its distinct keywords in the folded text; groups without
    a hit are absent."""
    pairs = []
    for tag, words in keywords.items():
        hits = sum((F.contains(low, F.lit(fold(w))).cast("int") for w in dict.fromkeys(words)), F.lit(0))
        pairs += [F.lit(tag), F.coalesce(hits, F.lit(0))]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def tags(hits: Column) -> Column:
    return F.map_keys(hits)


def score(tag_array: Column, weights: Mapping[str, int] = WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.aggregate(tag_array, F.lit(0), lambda total, tag: total + F.coalesce(table[tag], F.lit(1)))


def file_hints(low_name: Column, hints: Mapping[str, Sequence[str]] = FILE_HINTS) -> Column:
    """Topics that the folded file name points to."""
    found = [F.when(_contains_any(low_name, words), F.lit(topic)) for topic, words in hints.items()]
    return F.array_compact(F.array(*found))


def is_summary_page(text: Column, low_head: Column, marks: Sequence[str] = SUMMARY_MARKS) -> Column:
    """low_head: the folded first 800 characters."""
    return _contains_any(low_head, marks) & ~is_contents_line(text)


def _contains_any(low: Column, terms: Sequence[str]) -> Column:
    # Written out: a lambda may not hold a Python function's result.
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(low, F.lit(fold(term)))
    return F.coalesce(found, F.lit(False))


def window(text: Column, low: Column, tag_array: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS, limit: int = MAX_PARAGRAPH, lead: int = LEAD) -> Column:
    """A long text cut to a window that starts shortly before its first keyword."""
    found = [F.when(F.array_contains(tag_array, tag), F.nullif(F.locate(fold(w), low), F.lit(0))) for tag, words in keywords.items() for w in words]
    places = F.array(*found)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places) - 1 - lead, F.lit(0)))
    piece = F.substring(text, start + 1, F.lit(limit))
    cut = F.concat(F.when(start > 0, F.lit("[...] ")).otherwise(F.lit("")), piece, F.lit(" [...]"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def chunk(name: Column, para_id: Column, page: Column, text: Column) -> Column:
    """A paragraph with its mark, as it stands in an excerpt."""
    return F.concat(F.lit("["), name, F.lit(" ¶"), para_id, F.lit(", p."), page, F.lit("] "), text)


def cited_paragraph(c: Column) -> Column:
    """The paragraph id of a citation: after the first ¶, up to the first comma."""
    bare = F.btrim(stripped(F.coalesce(c, F.lit(""))), F.lit("[]"))
    after = F.when(F.contains(bare, F.lit("¶")), F.regexp_extract(bare, r"(?s)¶(.*)$", 1)).otherwise(bare)
    return stripped(F.substring_index(after, ",", 1))


MARK = r"(?d)\A\[(.*?)¶([^,\]]+), p\.([^\]]*)\]"


def marked(c: Column) -> tuple[Column, Column, Column]:
    """File, paragraph and page of the mark at a block's start ('' without one)."""
    return tuple(stripped(F.regexp_extract(c, MARK, i)) for i in (1, 2, 3))


def contextual_tags(hits: Column, low: Column, tag: str, needed: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """Drop one tag unless a needed term is there too, or if an excluded one is."""
    drop = ~_contains_any(low, needed) | _contains_any(low, excluded)
    return F.when(drop, F.map_filter(hits, lambda k, _: k != tag)).otherwise(hits)
