"""Articles out of HTML, in expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
# Elements that go with their content. Each alternative closes by its own name, and a name ends at white space or the bracket, so <header> is no <head>.
# One that never closes runs to the page's end, as in a browser; only the head's end may be left out.
HIDDEN = r"(?is)<(?:" + "|".join(rf"{name}(?:\s[^>]*)?>.*?(?:</{name}\s*>|\z)" for name in ("script", "style", "noscript")) + r"|head(?:\s[^>]*)?>.*?</head\s*>)"
NESTED = 4
COMMENT, TAG = r"(?s)<!--.*?-->", r"(?s)</?[a-zA-Z!?][^>]*>"
SPACE = r"[\x09-\x0D\xA0][\x20\x09-\x0D\xA0]*|\x20[\x20\x09-\x0D\xA0]+"  # a single space stays as it is
# Elements of HTML that begin and end a block, and those that hold no article by their meaning.
BLOCK = "address article blockquote body caption dd div dl dt fieldset figcaption figure form header hr html li main ol p pre section table tbody td tfoot th thead tr ul".split()
LANDMARK = "aside footer menu nav".split()
# A run of blocks pays this many words for each that is no heading, and a word in a link takes back what two words give.
BLOCK_COST, LINK_COST = 10, 2
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)"

# The character references of HTML 4 that texts use most; numeric ones are computed.
NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "middot": "·",
    "laquo": "«", "raquo": "»", "ndash": "–", "mdash": "—", "hellip": "…", "bull": "•", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "bdquo": "„", "deg": "°", "plusmn": "±", "times": "×", "euro": "€", "sect": "§", "shy": "­",
}
NUMBER = r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def decode(text: str | Column) -> Column:
    """Character references replaced, once: ``&amp;lt;`` reads ``&lt;``. Unknown and impossible ones stay as they are.

    Texts are parted at each ``&``; a part's name is looked up as far as its ``;``, and only parts that begin with ``#`` are read as numbers.
    """
    return bound(F.col(text) if isinstance(text, str) else text, lambda t: F.when(t.contains("&"), _decode_parts(t)).otherwise(t))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` reckoned once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _decode_parts(text: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv))

    def number(part: Column) -> Column:
        name = F.regexp_extract(part, NUMBER, 1)
        digits = F.when(F.lower(F.substring(name, 1, 1)) == "x", F.conv(F.substring(name, 2, 6), 16, 10)).when(name != "", name).cast("int")
        possible = ((digits > 8) & (digits < 0xD800)) | ((digits > 0xDFFF) & (digits <= 0x10FFFF))
        return F.when(possible, F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32"))

    def one(part: Column, place: Column) -> Column:
        end = F.instr(part, ";")
        char = F.when(end < 3, None).when(part.startswith("#"), number(part)).otherwise(names[F.substring(part, F.lit(1), end - 1)])
        return F.when(place == 0, part).otherwise(F.coalesce(F.concat(char, F.substring(part, end + 1, F.length(part))), F.concat(F.lit("&"), part)))

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def title(html: str) -> Column:
    return folded(decode(F.regexp_extract(html, TITLE, 1)))


def article(html: str) -> Column:
    """Visible text: scripts, styles and the head go with their content, tags go, references are decoded, white space folds."""
    return folded(decode(F.regexp_replace(_visible(F.col(html)), TAG, " ")))


def _visible(html: Column) -> Column:
    """Without comments and what is hidden. Templates hold templates, so the innermost go first, ``NESTED`` deep; one that never closes takes the rest."""
    x = F.regexp_replace(F.regexp_replace(html, "[\x07\x08]", " "), COMMENT, " ")
    x = F.regexp_replace(F.regexp_replace(x, HIDDEN, " "), _named(["template"], ""), "\x07")
    return bound(F.regexp_replace(x, _named(["template"], "/"), "\x08"), lambda x: F.when(x.rlike("[\x07\x08]"), _unnested(x)).otherwise(x))


def _unnested(x: Column) -> Column:
    for _ in range(NESTED):
        x = F.regexp_replace(x, "\x07[^\x07\x08]*\x08", " ")
    return F.translate(F.regexp_replace(x, "(?s)\x07.*", " "), "\x08", " ")


def _named(names: list[str], closing: str = "/?") -> str:
    return rf"(?is)<{closing}(?:{'|'.join(names)})(?:[\s/][^>]*)?>"


def blocks(html: str) -> Column:
    """The page's blocks in order: ``text``, ``n_words``, ``n_linked`` (words inside links), ``heading``, and how many landmarks open and close in it.

    Block elements part the page; all other tags leave a space. Null gives null.
    Control characters mark what the tags say, so those of the page itself read as spaces.
    """
    x = _visible(F.regexp_replace(html, "[\x01-\x06]", " "))
    for pattern, mark in (
        (_named(LANDMARK, ""), "\x01\x05"),
        (_named(LANDMARK, "/"), "\x06\x01"),
        (_named(["h[1-6]"], ""), "\x01\x04"),
        (_named([*BLOCK, "h[1-6]"]), "\x01"),
        (_named(["a"], ""), "\x02"),
        (_named(["a"], "/"), "\x03"),
        (TAG, " "),
    ):
        x = F.regexp_replace(x, pattern, mark)

    def one(part: Column) -> Column:
        text = folded(F.regexp_replace(part, "[\x02-\x06]", ""))
        outside = folded(F.regexp_replace(F.regexp_replace(part, "\x02[^\x02\x03]*(\x03|$)", " "), "[\x03-\x06]", ""))
        opens, closes = (F.length(part) - F.length(F.translate(part, c, "")) for c in ("\x05", "\x06"))
        return F.struct(text.alias("text"), outside.alias("outside"), part.contains("\x04").alias("heading"), opens.alias("opens"), closes.alias("closes"))

    def counted(b: Column) -> Column:
        n, free = (F.when(b[c] == "", 0).otherwise(F.size(F.split(b[c], " "))) for c in ("text", "outside"))
        return F.struct(b.text.alias("text"), n.alias("n_words"), (n - free).alias("n_linked"), *(b[c].alias(c) for c in ("heading", "opens", "closes")))

    return F.transform(F.transform(F.split(decode(x), "\x01"), one), counted)


def run(parts: Column) -> Column:
    """The article among ``blocks``: the run of them whose words, less the cost of its blocks and links, are most. ``first`` and ``last`` count from 0; no run is -1, -1.

    A heading costs nothing, and blocks inside a landmark count against the run. Of equal runs the one that ends first wins, then the shortest.
    """
    zero = F.struct(*(F.lit(v).alias(n) for n, v in (("k", 0), ("depth", 0), ("total", 0), ("start", 0), ("best", 0), ("first", -1), ("last", -1))))

    def step(a: Column, b: Column) -> Column:
        cost = F.when(b.heading, 0).otherwise(BLOCK_COST)
        gain = F.when(b.text == "", 0).when(a.depth + b.opens > 0, -b.n_words - cost).otherwise(b.n_words - LINK_COST * b.n_linked - cost)
        total, start = F.greatest(a.total, F.lit(0)) + gain, F.when(a.total <= 0, a.k).otherwise(a.start)
        better = total > a.best
        return F.struct(
            (a.k + 1).alias("k"), F.greatest(a.depth + b.opens - b.closes, F.lit(0)).alias("depth"), total.alias("total"), start.alias("start"),
            F.greatest(total, a.best).alias("best"), F.when(better, start).otherwise(a["first"]).alias("first"), F.when(better, a.k).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(parts, zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def extract(pages: DataFrame, html: str) -> DataFrame:
    """Adds ``blocks`` (those kept, in order) and ``body``, their texts by line: menus, advertisements and footers are outside the run. Null for a null page, empty where nothing is worth a run."""
    found = pages.withColumn("_parts", blocks(html)).withColumn("_run", run(F.col("_parts")))
    kept = F.when(F.col("_run.first") < 0, F.slice("_parts", 1, 0)).otherwise(F.slice("_parts", F.col("_run.first") + 1, F.col("_run.last") - F.col("_run.first") + 1))
    kept = F.transform(F.filter(kept, lambda b: b.text != ""), lambda b: F.struct(b.text.alias("text"), b.n_words.alias("n_words"), b.n_linked.alias("n_linked"), b.heading.alias("heading")))
    out = found.select(*pages.columns, kept.alias("blocks"))
    return out.withColumn("body", F.array_join("blocks.text", "\n"))


def host(url: str) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))
