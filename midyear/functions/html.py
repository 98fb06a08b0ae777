"""Column expressions on raw HTML: title, text blocks, page text, hrefs.

All of it is regular expressions, so it stays in the JVM. A pass over a page
costs much the same whatever it looks for; each result therefore takes one or
two passes that skip hidden content and find what they need at once. Patterns
start at ``<``, which is what makes a pass fast, and repeat no groups, which
would recurse on long pages.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from midyear import constants as K
from midyear.functions.binding import let

# What follows the ``<`` of a comment, a script or a style sheet, up to its end.
# Inside a tag a value in quotes may hold ``>``; a quote that does not open a value, or is never closed, is an ordinary
# character. The loop is possessive, so it neither backtracks nor recurses.
VALUE = "\"[^\"]*+\"|'[^']*+'|[^\\s>\"'][^\\s>]*+"
INSIDE = f"(?:[^>=]++|=\\s*+(?:{VALUE})?+)*+"
HIDDEN = (
    "!--.*?(?:-->|\\z)"
    f"|script(?:\\s{INSIDE})?>.*?(?:</script[^>]*>|\\z)"
    f"|style(?:\\s{INSIDE})?>.*?(?:</style[^>]*>|\\z)"
)
ATTRIBUTES = f"(?:[\\s/]{INSIDE})?"
TAG = f"<[A-Za-z/!?]{INSIDE}(?:>|\\z)"
TITLE = f"(?is)<(?:{HIDDEN}|title(?:\\s{INSIDE})?(>.*?)(?:</title|\\z))"
# The attributes of an anchor, and then one attribute of these.
ANCHOR = f"(?is)<(?:{HIDDEN}|a([\\s/]{INSIDE})(?:>|\\z))"
ATTRIBUTE = f"[^\\s\"'>/=][^\\s>/=]*+(?:\\s*+=\\s*+(?:{VALUE}))?+"
HREF = "(?is)^href\\s*+=\\s*+"
TAG_NAME = "^</?([A-Za-z][^\\s/>]*)"
NOT_SHOWN = f"(?is)<(?:{HIDDEN}|title(?:\\s{INSIDE})?>.*?(?:</title[^>]*>|\\z)|[A-Za-z/!?]{INSIDE}(?:>|\\z))"

# One pass drops every tag but those that bound blocks, and shortens these to
# their captured characters: a heading or paragraph becomes ``<h>`` or ``<p>``,
# its closing tag ``</>``, a tag that closes an open paragraph ``<<>``, and the
# closing tag of a container ``</``. Text cannot hold these: they read as tags.
BORDERS = (
    f"(?is)(?=<)(?:<(?:{HIDDEN})"
    f"|(<h)[0-9]{{1,2}}{ATTRIBUTES}(>)"
    f"|(<p){ATTRIBUTES}(>)"
    "|(</)(?:h[0-9]{1,2}|p)\\s*(>)"
    f"|((<))(?:{'|'.join(K.PARAGRAPH_CLOSERS)}){ATTRIBUTES}(>)"
    f"|(</)(?:{'|'.join(K.CONTAINERS)})\\s*>"
    f"|{TAG})"
)
BORDER_MARKS = "".join(f"${group}" for group in range(1, 11))
# A paragraph ends at any border, a heading at its closing tag or the next block.
BLOCK = "(?is)<(p>.*?(?=<(?:[hp]>|/|<>)|\\z)|h>.*?(?:</>|(?=<[hp]>|\\z)))"

ENTITY = "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"


def entity_names() -> dict[str, str]:
    """The named characters of HTML 4, with ``apos``."""
    return {"apos": "'", **{name: chr(code) for name, code in name2codepoint.items()}}


def _character(code: Column) -> Column:
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _number(digits: Column, base: int, most: int) -> Column:
    """Value of digits, however many zeros lead; 0 for more than ``most`` others, which no character needs."""
    return let(F.ltrim(digits, F.lit("0")), lambda d: F.when(F.length(d).between(1, most), F.conv(d, base, 10).cast("bigint")).otherwise(0))


def decode_entities(text: Column) -> Column:
    """Character references replaced; unknown or unfinished ones stay as they are."""
    names = F.str_to_map(
        F.lit("\x1e".join(f"{name}\x1f{char}" for name, char in entity_names().items())),
        F.lit("\x1e"),
        F.lit("\x1f"),
    )

    def replaced(piece: Column) -> Column:
        def with_found(found: Column) -> Column:
            name = F.rtrim(found, F.lit(";"))
            char = (
                F.when(found == "", None)
                .when(name.rlike("^#[xX]"), let(_number(F.substring(name, F.lit(3), F.length(name)), 16, 6), _character))
                .when(name.startswith("#"), let(_number(F.substring(name, F.lit(2), F.length(name)), 10, 7), _character))
                .otherwise(F.try_element_at(names, name))
            )
            rest = F.substring(piece, F.length(found) + 1, F.length(piece))
            return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

        return let(F.regexp_extract(piece, ENTITY, 1), with_found)

    def joined(pieces: Column) -> Column:
        tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), replaced)
        return F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))

    return let(text, lambda t: F.when(t.contains("&"), let(F.split(t, "&", -1), joined)).otherwise(t))


def drop_tags(html: Column) -> Column:
    return F.regexp_replace(html, TAG, "")


def _found(html: Column, pattern: str) -> Column:
    """What the group of ``pattern`` captured; hidden content captures nothing."""
    return F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda part: part != "")


def title(html: Column) -> Column:
    """Text of the first title element, untrimmed; ``''`` without one.

    Looks at the part before the first ``</title`` and, should that hold none,
    at the whole page.
    """
    head = F.get(_found(F.substring_index(html, "</title", 1), TITLE), F.lit(0))
    first = F.coalesce(head, F.get(_found(html, TITLE), F.lit(0)))
    return let(
        first,
        lambda part: F.when(part.isNull(), "").otherwise(decode_entities(drop_tags(F.substring(part, F.lit(2), F.length(part))))),
    )


def title_or_fallback(html: Column) -> Column:
    return F.coalesce(F.nullif(title(html), F.lit("")), F.lit(K.NO_TITLE))


def text_blocks(html: Column) -> Column:
    """Text of every heading (h0 to h99) and paragraph, in document order."""
    marked = F.regexp_replace(html, BORDERS, BORDER_MARKS)

    def text(block: Column) -> Column:
        content = F.substring(block, F.lit(3), F.length(block))
        # A heading closed by its own tag keeps what containers inside it held;
        # one left open ends where the container around it closes.
        heading = F.when(
            block.endswith("</>"), F.regexp_replace(content, "<<>|</>?", "")
        ).otherwise(F.replace(F.substring_index(content, "</", 1), F.lit("<<>"), F.lit("")))
        return decode_entities(F.when(F.lower(F.substring(block, 1, 1)) == "p", content).otherwise(heading))

    return F.transform(F.regexp_extract_all(marked, F.lit(BLOCK), F.lit(1)), text)


def block_line(block: Column) -> Column:
    """The non-blank lines of a block, each trimmed and led by one space."""
    # Line ends other than a line feed are rare, and looking for them is cheaper than replacing them.
    rare = [end for end in K.LINE_ENDS if end != "\n"]
    unusual = reduce(Column.__or__, (block.contains(end) for end in rare))
    plain = F.when(unusual, F.translate(block, "".join(rare), "\n" * len(rare))).otherwise(block)
    trimmed = F.transform(F.split(plain, "\n", -1), lambda line: F.btrim(line, F.lit(K.BLANKS)))
    lines = F.filter(trimmed, lambda line: line != "")
    return F.array_join(F.transform(lines, lambda line: F.concat(F.lit(" "), line)), "")


def text_of_blocks(blocks: Column) -> Column:
    """Page text: every non-blank block after three line feeds."""
    lines = F.filter(F.transform(blocks, block_line), lambda text: text != "")
    return F.array_join(F.transform(lines, lambda text: F.concat(F.lit("\n\n\n"), text)), "")


def page_text(html: Column) -> Column:
    return F.coalesce(text_of_blocks(text_blocks(html)), F.lit(""))


def hrefs(html: Column) -> Column:
    """Distinct ``href`` values of the anchors of a page, sorted by code point."""

    def bare(value: Column) -> Column:
        quoted = value.startswith("\"") | value.startswith("'")
        return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    def first(attributes: Column) -> Column:
        pairs = F.regexp_extract_all(attributes, F.lit(ATTRIBUTE), F.lit(0))
        return F.get(F.filter(pairs, lambda pair: pair.rlike(HREF)), F.lit(0))

    links = F.filter(F.transform(_found(html, ANCHOR), first), lambda pair: pair.isNotNull())
    return F.array_sort(F.array_distinct(F.transform(links, lambda pair: decode_entities(let(F.regexp_replace(pair, HREF, ""), bare)))))


def _opened(inside: Column, tag: Column) -> Column:
    """The open elements after a tag, innermost first, as in ``/p/body/html/``. Comments, void and whole hidden elements open nothing."""

    def after(name: Column) -> Column:
        closed = let(
            F.position(F.concat(F.lit("/"), name, F.lit("/")), inside),
            lambda place: F.when(place > 0, F.substring(inside, place + F.length(name) + 1, F.length(inside))).otherwise(inside),
        )
        whole = name.isin("", "script", "style", "title", *K.VOID_ELEMENTS) | tag.endswith("/>")
        return F.when(tag.startswith("</"), closed).when(whole, inside).otherwise(F.concat(F.lit("/"), name, inside))

    return let(F.lower(F.regexp_extract(tag, TAG_NAME, 1)), after)


def visible_texts(html: Column) -> Column:
    """Text nodes of elements other than head, meta, title, script and style; comments and blank nodes dropped.

    Text outside any element is dropped too. A closing tag ends the innermost open
    element of its name and what is open inside it; one that matches none is ignored.
    """

    def shown(nodes: Column) -> Column:
        start = F.struct(F.lit("/").alias("inside"), F.lit(1).alias("n"), F.array(F.lit(0)).alias("dropped"))

        def step(state: Column, tag: Column) -> Column:
            def moved(inside: Column) -> Column:
                own = F.substring_index(inside, "/", 2)
                # Only nodes that hold text are noted, so the list stays short.
                text = F.btrim(F.get(nodes, state["n"]), F.lit(K.BLANKS)) != ""
                drop = text & (own.isin("/", *(f"/{name}" for name in K.TEXT_NOT_SHOWN)))
                return F.struct(
                    inside.alias("inside"),
                    (state["n"] + 1).alias("n"),
                    F.when(drop, F.array_append(state["dropped"], state["n"])).otherwise(state["dropped"]).alias("dropped"),
                )

            return let(_opened(state["inside"], tag), moved)

        tags = F.regexp_extract_all(html, F.lit(NOT_SHOWN), F.lit(0))
        dropped = F.aggregate(tags, start, step, lambda state: state["dropped"])
        return let(dropped, lambda places: F.filter(nodes, lambda _, i: ~F.array_contains(places, i)))

    nodes = let(F.split(html, NOT_SHOWN, -1), shown)
    return F.filter(F.transform(nodes, decode_entities), lambda node: F.btrim(node, F.lit(K.BLANKS)) != "")
