"""Text expressions that follow Python's string rules inside Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class, valid in Java and in RE2.
BLANK_CLASS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
# The line ends of Python's str.splitlines().
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


# Where a message is sent and the word it starts with.
LINK_PREFIX = "sms:139?body="
KEYWORD = "MADAD"


def strip(c: Column) -> Column:
    """Both ends freed of every Unicode blank; linear in the text, no regex."""
    return F.btrim(c, F.lit(BLANKS))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def present(c: Column) -> Column:
    """``c`` where it holds more than blanks, otherwise null. The value is unchanged."""
    return F.when(strip(c) != "", c)


def filled(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def drop_closed_think(c: Column, any_case: bool = False) -> Column:
    """``c`` without closed think blocks.

    Blocks are only looked for up to the last closing tag: behind it every opening
    tag would search the rest of the text in vain.
    """
    flags = "(?is)" if any_case else "(?s)"
    head = F.regexp_extract(c, flags + r"\A.*</think>", 0)
    blocks = F.regexp_replace(head, flags + "<think>.*?</think>", "")
    return F.concat(blocks, F.substr(c, F.length(head) + 1))


def visible_reply(c: Column) -> Column:
    """A chat reply without closed think blocks in any case; an unclosed one stays."""
    return strip(drop_closed_think(c, any_case=True))


def complaint_line(c: Column) -> Column:
    """The message line of a model reply.

    Think blocks go, closed or not; one leading label goes; the first line with
    more than five characters after unquoting wins, else the whole text.
    """
    text = strip(drop_closed_think(strip(c)))
    text = strip(F.regexp_replace(text, "(?s)<think>.*", ""))
    label = rf"(?i)\A(sms{BLANK_CLASS}+complaint|complaint|output){BLANK_CLASS}*:{BLANK_CLASS}*"
    text = F.regexp_replace(text, label, "")
    lines = F.transform(
        F.split(text, LINE_END),
        lambda x: strip(strip_chars(strip_chars(strip(x), '"'), "*")),
    )
    return F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) > 5), F.lit(0)), strip(text))


def percent_encoded(c: Column) -> Column:
    """Percent-encoding where only unreserved characters stay as they are."""
    form = F.url_encode(c)
    return F.replace(
        F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
        F.lit("%7E"),
        F.lit("~"),
    )


def send_link(message: Column) -> Column:
    return F.concat(F.lit(LINK_PREFIX), percent_encoded(F.concat(F.lit(KEYWORD + " "), message)))


def flat_page(c: Column) -> Column:
    """Page text on one line: newline to space, outer blanks off, null to empty."""
    return strip(F.translate(F.coalesce(c, F.lit("")), "\n", " "))


def words(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def hashed_counts(c: Column, dims: int) -> Column:
    """Word counts in ``dims`` hashed slots, an integer vector for any text."""
    slots = F.transform(
        words(c),
        lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dims,
    )
    every = F.sequence(F.lit(0), F.lit(dims - 1))

    def counted(s: Column) -> Column:
        return F.transform(every, lambda d: F.size(s) - F.size(F.array_remove(s, d)))

    # The one-element array binds the slots, so that a text is hashed once.
    return F.transform(F.array(slots), counted)[0]
