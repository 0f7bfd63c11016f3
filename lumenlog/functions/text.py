"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a volatile token, most specific first, and its placeholder.
TOKENS = (
    ("<TS>", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("<UUID>", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("<HEX>", r"0[xX][0-9a-fA-F]+|\b(?=[0-9a-fA-F]{8,}\b)(?=[0-9]*[a-fA-F])[0-9a-fA-F]+"),
    ("<PATH>", r"(?:/[\w.\-]+){2,}|(?:[A-Za-z]:)?(?:\\[\w.\-]+){2,}"),
    ("<NUM>", r"\b\d+\b"),
)
_ANY = "(?U)" + "|".join(f"({pattern})" for _, pattern in TOKENS)
#: Severity words of free text.
SEVERITY_WORDS = {
    "fatal": "fatal", "critical": "fatal", "crit": "fatal", "error": "error", "err": "error", "warning": "warn", "warn": "warn",
    "info": "info", "notice": "info", "debug": "debug", "trace": "debug", "fine": "debug",
}
#: Namespaces that never name an application frame.
RUNTIME_NAMESPACES = ("std::", "boost::", "__gnu_cxx::", "abi::")


def mask(message: str | Column) -> Column:
    """The message with volatile tokens replaced by placeholders, in one leftmost-first pass.

    Tokens are cut out once and told apart on their own: no token of one kind is, taken alone, a token of another.
    """
    m = F.col(message) if isinstance(message, str) else message

    def kind(token: Column) -> Column:
        tests = [F.when(token.rlike(f"(?U)^(?:{pattern})$"), F.lit(name)) for name, pattern in reversed(TOKENS)]
        return F.coalesce(*tests, F.lit(""))

    kinds = F.transform(F.regexp_extract_all(m, F.lit(_ANY), F.lit(0)), kind)
    pieces = F.zip_with(F.split(m, _ANY, -1), F.concat(kinds, F.array(F.lit(""))), lambda gap, placeholder: F.concat(gap, placeholder))
    return F.when(m.rlike(_ANY), F.array_join(pieces, "")).otherwise(m)


def short_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(F.col(text) if isinstance(text, str) else text, 256), 1, 16)


def event_identity(source_file: Column, byte_offset: Column) -> Column:
    """The identity of the event that starts at a byte of a file."""
    return short_hash(F.concat(source_file, F.lit("\0"), byte_offset.cast("string")))


def severity_of(text: Column) -> Column:
    """Severity by the first severity word of a free text; unknown without one."""
    word = F.lower(F.regexp_extract(text, r"(?i)\b(" + "|".join(sorted(SEVERITY_WORDS, key=len, reverse=True)) + r")\b", 1))
    table = F.create_map(*[F.lit(x) for pair in SEVERITY_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, word), F.lit("unknown"))


def priority_severity(priority: Column) -> Column:
    """Syslog priority 0 to 7 as severity."""
    return F.when(priority.between(0, 2), "fatal").when(priority == 3, "error").when(priority == 4, "warn").when(priority.between(5, 6), "info").when(priority == 7, "debug").otherwise("unknown")


def finite_number(text: Column) -> Column:
    """A finite double from plain decimal notation, else null."""
    clean = F.trim(text)
    parsed = F.when(clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), clean.try_cast("double"))
    return F.when(F.abs(parsed) < float("inf"), parsed)


def sanitise(text: Column) -> Column:
    """Text without control and format characters, but for newline and tab."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t]]|\p{Cf}", "")


def csv_safe(text: Column) -> Column:
    """Text that a spreadsheet does not take for a formula."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def frames_of(raw: Column) -> Column:
    """Normalised symbols of the stack frames in a thread record, outermost last."""
    lines = F.filter(F.split(raw, r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]"), lambda x: x.rlike(r"^#\d+\s+0x[0-9A-Fa-f]+\s+."))
    return F.transform(lines, lambda x: normalise_symbol(F.regexp_extract(x, r"^#\d+\s+0x[0-9A-Fa-f]+\s+(.+)$", 1)))


def normalise_symbol(symbol: Column) -> Column:
    return F.trim(F.split_part(F.trim(F.split_part(symbol, F.lit(" - "), F.lit(1))), F.lit("@"), F.lit(1)))


def resolvable(frame: Column) -> Column:
    return (frame != "") & (frame != "??") & ~frame.rlike("^0x[0-9A-Fa-f]+$")


def enclosing_frame(frames: Column, index: Column) -> Column:
    """The first application frame after a 0-based index, null if there is none."""
    rest = F.slice(frames, index + 2, F.greatest(F.size(frames), F.lit(1)))
    own = lambda f: resolvable(f) & f.contains("::") & ~F.coalesce(*[F.when(f.startswith(n), True) for n in RUNTIME_NAMESPACES], F.lit(False))
    return F.get(F.filter(rest, own), F.lit(0))


def mebibytes(size: Column) -> Column:
    """Bytes as MB, to three places."""
    return F.round(size.cast("double") / F.lit(1048576.0), 3)


def iso_utc(ts: Column) -> Column:
    """A time as ISO text in UTC, with microseconds only where there are any; sessions run in UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.unix_micros(ts.cast("timestamp")) % 1000000
    return F.concat(whole, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))), F.lit("+00:00"))


def markdown_safe(text: Column) -> Column:
    """Text in which Markdown and HTML have no effect, on one line."""
    html = F.replace(F.replace(F.replace(sanitise(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(F.regexp_replace(html, r"([\\`*_{}\[\]()#+!|~-])", r"\\$1"), r"[\n\t]+", " ")


def cut_bytes(text: Column, limit: int = 2048) -> Column:
    """The longest prefix of at most limit UTF-8 bytes that ends with a whole character."""
    # A broken last character is up to three bytes long.
    cut = [F.try_validate_utf8(F.substring(F.encode(text, "UTF-8"), 1, limit - n).cast("string")) for n in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cut))


def citation_prefix(ids: Column) -> Column:
    """[evt:id] for each id."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("[evt:"), x, F.lit("]"))), "")


def sampling_note(shown: Column, of: Column) -> Column:
    """How many of how many events are cited."""
    return F.concat(F.lit("("), F.format_number(shown, 0), F.lit(" of "), F.format_number(of, 0), F.lit(" thread events cited as exemplars)"))


def string_list(json: Column) -> Column:
    """A JSON array as strings; any other text is a list of itself, null an empty one."""
    listed = F.from_json(json, "array<string>")
    return F.when(json.isNull(), F.array().cast("array<string>")).when(F.ltrim(json).startswith("[") & listed.isNotNull(), F.array_compact(listed)).otherwise(F.array(json))


def string_map(json: Column) -> Column:
    """A JSON object as strings by key; any other text under the key value, null as an empty map."""
    found = F.from_json(json, "map<string,string>")
    return F.when(json.isNull(), F.create_map().cast("map<string,string>")).when(F.ltrim(json).startswith("{") & found.isNotNull(), found).otherwise(F.create_map(F.lit("value"), json))


def bad_cells(values: Column) -> Column:
    """Positions (0-based) of the cells that are no numbers; nan and infinities count as numbers here."""
    number = r"^\s*[+-]?(nan|inf|infinity|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)\s*$"
    return F.array_compact(F.transform(values, lambda v, i: F.when(~F.lower(v).rlike(number), i)))


def iso_moment(text: Column) -> Column:
    """ISO text as a time, null if it is none; without an offset it is UTC."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})?)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def syslog_moment(text: Column, modified: Column) -> Column:
    """The stamp `Mon d HH:MM:SS` that text begins with, in the year of the file's modification or, if it lies over a day after that, the one before."""
    parts = r"^([A-Z][a-z]{2}) {1,2}(\d{1,2}) (\d{2}):(\d{2}):(\d{2})\s"
    part = lambda n: F.regexp_extract(text, parts, n)
    month = F.array_position(F.array(*[F.lit(x) for x in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")]), part(1))
    at = lambda year: F.try_make_timestamp(year, month.cast("int"), part(2).try_cast("int"), part(3).try_cast("int"), part(4).try_cast("int"), part(5).try_cast("decimal(8,6)"))
    here = at(F.year(modified))
    return F.when(text.rlike(parts), F.when(here <= modified + F.expr("interval 1 day"), here).otherwise(F.when(here.isNotNull(), at(F.year(modified) - 1))))


def epoch_moment(text: Column) -> Column:
    """Seconds (ten digits, with or without a fraction) or milliseconds (thirteen) since 1970 that text begins with, between the years 2000 and 2100."""
    word = F.regexp_extract(text, r"^(\d{13}|\d{10}(?:\.\d+)?)(?=\s|$)", 1)
    value = F.when(word.rlike(r"^\d{13}$"), word.try_cast("double") / 1000).otherwise(word.try_cast("double"))
    return F.when(value.between(946684800, 4102444800), F.timestamp_micros(F.round(value * 1000000).cast("long")))


def clf_moment(text: Column) -> Column:
    """The stamp `dd/Mon/yyyy:HH:MM:SS +zzzz`, with or without a bracket, that text begins with."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"^\[?(\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\]?", 1), F.lit("")), F.lit("d/MMM/yyyy:HH:mm:ss Z"))
