"""Mention search: a dictionary of word forms built once, compiled to an automaton over words (``automaton``), and walked once a text.

Morphology is a rule: endings of Russian nouns and adjectives by case. In names of several words all words agree in case, or only the first or the last
one is inflected (an apposition). ``ё`` reads as ``е`` in names and texts. Two variants: ``TELEGRAM`` also accepts tickers,
``MEDIA`` only names. Names of several words match as word sequences. Securities listed as ``common``, whose one-word names are ordinary words,
need a second sign: the name must be capitalised in the text or follow a quotation mark.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf

from tidemark.operators import automaton
from tidemark.operators.automaton import Automaton

# Endings of Russian nouns and adjectives in nominative, genitive, dative, accusative, instrumental and prepositional, singular and plural
# together; what they replace is the key, longest first, and "" follows a last consonant.
ADJECTIVES = {
    "ый": (("ый",), ("ого",), ("ому",), ("ый", "ого"), ("ым",), ("ом",)),
    "ий": (("ий",), ("ого", "его"), ("ому", "ему"), ("ий", "ого", "его"), ("им",), ("ом", "ем")),
    "ой": (("ой",), ("ого",), ("ому",), ("ой", "ого"), ("ым", "им"), ("ом",)),
    "ая": (("ая",), ("ой", "ей"), ("ой", "ей"), ("ую",), ("ой", "ою", "ей"), ("ой", "ей")),
    "яя": (("яя",), ("ей",), ("ей",), ("юю",), ("ей", "ею"), ("ей",)),
    "ое": (("ое",), ("ого",), ("ому",), ("ое",), ("ым", "им"), ("ом",)),
    "ее": (("ее",), ("его",), ("ему",), ("ее",), ("им",), ("ем",)),
    "ые": (("ые",), ("ых",), ("ым",), ("ые", "ых"), ("ыми",), ("ых",)),
    "ие": (("ие",), ("их",), ("им",), ("ие", "их"), ("ими",), ("их",)),
}
NOUNS = {
    "ия": (("ия", "ии"), ("ии", "ий"), ("ии", "иям"), ("ию", "ии"), ("ией", "иями"), ("ии", "иях")),
    "а": (("а", "ы", "и"), ("ы", "и"), ("е", "ам"), ("у",), ("ой", "ою", "ей", "ами"), ("е", "ах")),
    "я": (("я", "и"), ("и",), ("е", "ям"), ("ю",), ("ей", "ею", "ями"), ("е", "ях")),
    "ь": (("ь", "и"), ("и", "я", "ей"), ("и", "ю", "ям"), ("ь", "я"), ("ью", "ем", "ями"), ("и", "е", "ях")),
    "й": (("й", "и"), ("я", "ев"), ("ю", "ям"), ("й", "я"), ("ем", "ями"), ("е", "ях")),
    "о": (("о", "а"), ("а",), ("у", "ам"), ("о",), ("ом", "ами"), ("е", "ах")),
    "е": (("е", "я"), ("я", "ей"), ("ю", "ям"), ("е",), ("ем", "ями"), ("е", "и", "ях")),
    "ии": (("ии",), ("ий",), ("иям",), ("ии",), ("иями",), ("иях",)),
    "и": (("и",), ("ей", "ов", "ий"), ("ям", "ам"), ("и",), ("ями", "ами"), ("ях", "ах")),
    "ы": (("ы",), ("ов",), ("ам",), ("ы",), ("ами",), ("ах",)),
    "": (("", "ы", "и"), ("а", "ов"), ("у", "ам"), ("", "а"), ("ом", "ем", "ами"), ("е", "ах")),
}
# Other names that the press gives to issuers of the Moscow exchange, those of Latin names in Cyrillic among them.
PRESS_NAMES = {
    "CBOM": ("МКБ",), "FEES": ("Россети",), "GMKN": ("Норникель",), "HEAD": ("Хэдхантер",), "MDMG": ("Мать и дитя",), "MOEX": ("Мосбиржа",), "MTSS": ("МТС",),
    "OZON": ("Озон",), "SBER": ("Сбер", "Сбербанк"), "SBERP": ("Сбер", "Сбербанк"), "T": ("Т-Банк", "Тинькофф"), "VTBR": ("ВТБ",),
}
#: Issuers whose one-word names are ordinary words too; for ``common``.
ORDINARY = ("LENT", "MGNT", "PIKK", "PLZL", "SMLT")

_WORD = re.compile(r"[^\W_]+")
_OPENING = "«„“\"'"


@dataclass(frozen=True)
class Variant:
    kind: str
    tickers: bool


TELEGRAM, MEDIA = Variant("tg", True), Variant("media", False)


def words(name: str) -> list[str]:
    return re.findall(r"[^\W_]+", name.lower())


def cases(word: str) -> list[set[str]]:
    """Forms of a lower-case word by case; a word in Latin script, with digits, or short stays as it is."""
    word = word.replace("ё", "е")
    if not re.fullmatch("[а-я]{3,}", word):
        return [{word}] * 6
    out: list[set[str]] = [set() for _ in range(6)]
    tables = [ADJECTIVES] if word.endswith(("ая", "яя", "ый", "ые", "ое", "ее")) and len(word) > 4 else [ADJECTIVES, NOUNS] if word.endswith(("ий", "ой", "ие")) else [NOUNS]
    for table in tables:
        end = next((e for e in table if e and word.endswith(e)), "")
        if end or word[-1] not in "аеиоуыэюя":
            for found, endings in zip(out, table.get(end, ())):
                found.update(word[: len(word) - len(end)] + e for e in endings)
    return [found or {word} for found in out]


def forms(word: str) -> list[str]:
    """All inflected forms of a lower-case word."""
    return sorted(set().union(*cases(word)))


def phrases(name: Sequence[str]) -> set[str]:
    """Forms of a name: its words agree in case, or only the first or the last one is inflected, or both of them freely."""
    by_case = [cases(w) for w in name]
    out = {" ".join(p) for k in range(6) for p in product(*(c[k] for c in by_case))}
    if len(name) > 1:
        middle = [w.replace("ё", "е") for w in name[1:-1]]
        out |= {" ".join([a, *middle, z]) for a in forms(name[0]) for z in forms(name[-1])}
    return out


def aliases(name: str) -> list[str]:
    """The name, without share-class suffix and without brackets, and each bracketed alternative."""
    plain = re.sub(r"\s+[—–-]\s+\w+$", "", name)
    inside = re.findall(r"\(([^)]*)\)", plain)
    return [a for a in (re.sub(r"\([^)]*\)", " ", plain).strip(), *inside) if words(a)]


def dictionary(securities: list[tuple[str, str]], variant: Variant, also: Mapping[str, Sequence[str]] = {}) -> list[tuple[str, int, str]]:
    """``form, n_words, ticker`` for (ticker, name) pairs; ``also`` has further names of a ticker, such as ``PRESS_NAMES``."""
    out = set()
    for ticker, name in securities:
        for alias in (*aliases(name), *also.get(ticker, ())):
            w = words(alias)
            out |= {(p, len(w), ticker) for p in phrases(w)}
        if variant.tickers and len(ticker) > 1:
            out.add((ticker.lower(), 1, ticker))
    return sorted(out)


def found_in(text: str, phrases: Automaton, common: Collection[str]) -> set[str]:
    """Tickers named in a text."""
    plain = text.replace("ё", "е").replace("Ё", "Е")
    out, places = set(), None
    for at, ends in phrases.matches(_WORD.findall(plain.lower())):
        for ticker, ordinary in ends:
            if ticker in out:
                continue
            if ordinary and ticker in common:
                # Where the word stands is looked up only here.
                places = list(_WORD.finditer(plain)) if places is None else places
                word = places[at]
                if word[0][0] == word[0][0].lower() and plain[word.start() - 1 : word.start()] not in tuple(_OPENING):
                    continue
            out.add(ticker)
    return out


def find(news: DataFrame, phrases: str, key: str, text: str, common: Collection[str] = ()) -> DataFrame:
    """Distinct ``key, ticker``, by the compiled file ``phrases``. Texts stay where they are read; a null text names nothing."""
    common = frozenset(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = automaton.load(phrases)
        for batch in batches:
            hits = [sorted(found_in(t, compiled, common)) if t else [] for t in batch.column(1).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(hits)), list(map(len, hits))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([t for h in hits for t in h], pa.string())], names=[key, "ticker"])

    return news.select(key, text).mapInArrow(run, f"`{key}` {dict(news.dtypes)[key]}, ticker string").distinct()


def search(spark: SparkSession, news: DataFrame, securities: list[tuple[str, str]], variant: Variant, key: str = "news_id", text: str = "text", kind: str | None = "source_kind", common: Collection[str] = (), also: Mapping[str, Sequence[str]] = {}) -> DataFrame:
    """Mentions of ``securities`` in the news of the variant's kind."""
    own = news.where(F.col(kind) == variant.kind) if kind else news
    # A form that is the ticker itself needs no second sign.
    phrases = [(form.split(), (ticker, n == 1 and form != ticker.lower())) for form, n, ticker in dictionary(securities, variant, also)]
    return find(own, automaton.write(spark, phrases), key, text, common)


@udtf(returnType="ticker string, place int")
class CashTags:
    """Tickers written as ``$SBER`` with their place in the text, one row each: a table function for lateral joins."""

    def eval(self, text: str):
        for m in re.finditer(r"\$([A-Z]{1,5})\b", text or ""):
            yield m[1], m.start()


def cash_tags(news: DataFrame, key: str, text: str) -> DataFrame:
    """``key, ticker, place`` of all tags; texts without any give no rows."""
    return news.lateralJoin(CashTags(F.col(text).outer())).select(key, "ticker", "place")
