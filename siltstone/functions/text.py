"""Text operators: lines, titles, snippets, ranges, tokens, ids and paths.

All are column expressions but for the byte range and the chunker, which need
UTF-8 offsets and run as Arrow functions. Null in, null out, unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

HEAD_LINES = 6
AROUND = 2
SNIPPET_BYTES = 400
TOKEN_LIMIT = 40
CHUNK_CHARS = 1200
LOOK_BACK = 100


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end opens no further line."""
    t = _c(text)
    parts = F.split(F.regexp_replace(t, r"\r?\n\z", ""), r"\r?\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(parts)


def strip_front_matter(text: Column | str) -> Column:
    """Drop a leading `---` block closed by `---` or `...`; an unclosed one stays."""
    return F.regexp_replace(_c(text), r"(?s)\A---\r?\n(?:.*?\n)??(?:---|\.\.\.)\r*(?:\n|\z)", "")


def title(text: Column | str, path: Column | str) -> Column:
    """The first level-one heading, else the file's stem, else `untitled`."""
    head = F.nullif(F.rtrim(F.regexp_extract(_c(text), r"(?m)^[ \t]*# [ \t]*(\S[^\r\n]*)", 1)), F.lit(""))
    name = F.element_at(F.split(_c(path), "/"), -1)
    stem = F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(""))
    return F.coalesce(head, stem, F.lit("untitled"))


def number_lines(text: Column | str, first: int = 1) -> Column:
    return F.array_join(F.transform(lines(text), lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(s: Column) -> Column:
    """At most SNIPPET_BYTES bytes, cut at a character."""

    def cut(x: Column) -> Column:
        raw = x.cast("binary")
        # the later bytes of a character are 80 to BF, and it has three of them at most
        end = F.lit(SNIPPET_BYTES - 3)
        for n in range(SNIPPET_BYTES - 2, SNIPPET_BYTES + 1):
            end = F.when(~F.hex(F.substring(raw, n + 1, 1)).between("80", "BF"), n).otherwise(end)
        return F.when(F.octet_length(x) > SNIPPET_BYTES, F.substring(raw, F.lit(1), end).cast("string")).otherwise(x)

    return _let(s, cut)


def snippet(text: Column | str, query: str) -> Column:
    """text, start_line: two lines around the first line holding the query, else the head."""

    def around(ls: Column, at: Column) -> Column:
        first = F.when(at > 0, F.greatest(at - AROUND, F.lit(1))).otherwise(1)
        last = F.when(at > 0, F.least(at + AROUND, F.size(ls))).otherwise(F.least(F.lit(HEAD_LINES), F.size(ls)))
        body = _cut(F.array_join(F.slice(ls, first, F.greatest(last - first + 1, F.lit(0))), "\n"))
        return F.when(F.size(ls) > 0, F.struct(body.alias("text"), first.alias("start_line")))

    def found(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), F.lit(query.lower()))), True).cast("int")
        return _let(at, lambda at: around(ls, at))

    return _let(lines(text), found)


def excerpts(text: Column | str, query: str, most: int = 3) -> Column:
    """Excerpts around all matching lines, those that overlap or touch merged."""
    q = F.lit(query.lower())
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def fold(acc: Column, s: Column) -> Column:
        tail = F.element_at(acc, -1)
        joined = F.struct(tail["a"].alias("a"), F.greatest(tail["b"], s["b"]).alias("b"))
        return (
            F.when(F.size(acc) == 0, F.array(s))
            .when(F.size(acc) > most, acc)  # the first ones are whole, as lines come in order
            .when(s["a"] - 1 <= F.try_element_at(acc, F.lit(-1))["b"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(s)))
        )

    def found(ls: Column) -> Column:
        hits = F.filter(F.transform(ls, lambda x, i: F.when(F.contains(F.lower(x), q), i + 1)), lambda x: x.isNotNull())
        spans = F.transform(hits, lambda i: F.struct(F.greatest(i - AROUND, F.lit(1)).alias("a"), F.least(i + AROUND, F.size(ls)).alias("b")))
        head = F.array(F.struct(F.lit(1).alias("a"), F.least(F.lit(HEAD_LINES), F.size(ls)).alias("b")))
        merged = F.slice(F.aggregate(_let(spans, lambda s: F.when(F.size(s) > 0, s).otherwise(head)), empty, fold), 1, most)
        out = F.transform(
            merged,
            lambda s: F.struct(_cut(F.array_join(F.slice(ls, s["a"], s["b"] - s["a"] + 1), "\n")).alias("text"), s["a"].alias("start_line"), s["b"].alias("end_line")),
        )
        return F.when(F.size(ls) > 0, out).otherwise(F.slice(out, 1, 0))

    return _let(lines(text), found)


def line_range(text: Column | str, first: int | None = None, last: int | None = None) -> Column:
    """Lines first..last (from 1, inclusive), with a note on what follows if `last` is given."""
    ls = lines(text)
    a = max(first or 1, 1)
    b = F.size(ls) if last is None else F.least(F.lit(last), F.size(ls))
    body = F.array_join(F.slice(ls, a, F.greatest(b - a + 1, F.lit(0))), "\n")
    left = F.size(ls) - b
    note = F.concat(F.lit("\n\n[... "), left.cast("string"), F.when(left == 1, " more line").otherwise(" more lines"), F.lit(" remaining]"))
    if last is not None:
        body = F.when(left > 0, F.concat(body, note)).otherwise(body)
    return F.when(b >= a, body).when(_c(text).isNotNull(), "")


def byte_range(text: Column | str, first: int | None = None, last: int | None = None) -> Column:
    """UTF-8 bytes first..last (from 0, inclusive), both moved down to a character's start."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        raw = t.encode("utf-8", "surrogatepass")

        def floor(i: int) -> int:
            while 0 < i < len(raw) and raw[i] & 0xC0 == 0x80:
                i -= 1
            return i

        a = floor(min(first or 0, len(raw)))
        if a >= len(raw) or (last is not None and last < a):
            return ""
        b = len(raw) if last is None else floor(min(last + 1, len(raw)))
        if b <= a:
            return ""
        left = len(raw) - b
        note = f"\n\n[... {left} more {'byte' if left == 1 else 'bytes'} remaining]" if last is not None and left else ""
        return raw[a:b].decode("utf-8", "replace") + note

    return F.pandas_udf(lambda s: s.map(one), StringType())(_c(text))


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits shorter than TOKEN_LIMIT bytes."""
    return F.filter(F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: F.octet_length(t) < TOKEN_LIMIT)


CHUNKS = ArrayType(StructType([StructField("text", StringType()), StructField("idx", IntegerType()), StructField("start_byte", LongType())]))


def chunk(t: str | None, size: int = CHUNK_CHARS, overlap: int = 0, contiguous: bool = False) -> list[tuple[str, int, int]]:
    """Chunks of at most `size` characters that end behind white space where there is any near.

    The next chunk begins `size - overlap` characters further on, wherever the
    last one ended; contiguous=True starts it at that end instead, so nothing
    lies between two chunks. A rest under a quarter of `size` is left out
    once there is a chunk (kept if contiguous).
    """
    if not t or not t.strip():
        return []
    if len(t) <= size:
        return [(t, 0, 0)]
    out: list[tuple[str, int, int]] = []
    step, at, seen_chars, seen_bytes = max(size - overlap, 1), 0, 0, 0
    while at < len(t):
        end = min(at + size, len(t))
        if end < len(t):
            low = max(end - LOOK_BACK, at + 1 if size < LOOK_BACK else 0)
            gap = next((i for i in range(end - 1, low - 1, -1) if t[i].isspace()), None)
            end = end if gap is None else gap + 1
        seen_bytes += len(t[seen_chars:at].encode("utf-8", "surrogatepass"))
        seen_chars = at
        if t[at:end].strip():
            out.append((t[at:end], len(out), seen_bytes))
        at = max(end - overlap, at + 1) if contiguous else at + step
        if not contiguous and len(t) - at < size // 4 and out:
            break
    return out


def chunks(text: Column | str, size: int = CHUNK_CHARS, overlap: int = 0, contiguous: bool = False) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: chunk(t, size, overlap, contiguous)), CHUNKS)(_c(text))


# --- ids and paths ----------------------------------------------------------------------------


def document_hex(collection: Column | str, path: Column | str) -> Column:
    """64 hex digits that identify a document by collection and path."""
    sep = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(_c(collection).cast("string"), sep, _c(path)), 256)


def short_id(full: Column | str, length: int = 6) -> Column:
    return F.substring(_c(full), 1, min(max(length, 6), 64))


def chunk_hex(text: Column | str, model: str = "") -> Column:
    """16 hex digits that identify a chunk by model and content."""
    sep = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.substring(F.sha2(F.concat(F.lit("chunk"), sep, F.lit(model), sep, _c(text)), 256), 1, 16)


def safe_path(path: Column | str) -> Column:
    """A relative path without `.` parts; null if empty, absolute or leading upwards."""
    p = _c(path)
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    bad = F.trim(p).eqNullSafe("") | p.startswith("/") | F.exists(F.split(p, "/"), lambda x: x == "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def document_uri(collection: Column | str, path: Column | str, scheme: str = "doc") -> Column:
    """URI whose segments have everything but letters and digits percent-encoded."""
    encoded = F.url_encode(F.concat_ws("/", _c(collection), _c(path)))
    for plain, code in (("+", "%20"), ("-", "%2D"), ("_", "%5F"), (".", "%2E"), ("*", "%2A"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(plain), F.lit(code))
    return F.concat(F.lit(f"{scheme}://"), encoded)


def uri_parts(uri: Column | str, scheme: str = "doc") -> Column:
    """collection, path of a document URI; null if it is none."""
    u = _c(uri)
    rest = F.url_decode(F.replace(F.substr(u, F.lit(len(scheme) + 4)), F.lit("+"), F.lit("%2B")))
    coll, path = F.regexp_extract(rest, r"^([^/]*)/", 1), F.regexp_extract(rest, r"(?s)^[^/]*/(.*)$", 1)
    return F.when(u.startswith(f"{scheme}://") & (coll != "") & (path != ""), F.struct(coll.alias("collection"), path.alias("path")))


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob in which `*` also crosses `/`."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        else:
            out.append("\\" + ch if ch in ".^$+()|{}[]\\" else ch)
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def front_matter_map(text: Column | str) -> Column:
    """`key: value` pairs of the front matter; of repeated keys the last counts."""
    block = F.regexp_extract(_c(text), r"(?s)\A---\r?\n(.*?\n)??(?:---|\.\.\.)\r*(?:\n|\z)", 1)
    pairs = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z0-9_-]+:[^\r\n]*)"), F.lit(1))
    entry = F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).alias("k"), F.trim(F.substr(p, F.instr(p, ":") + 1)).alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.greatest(F.size(entry) - i - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def wiki_links(text: Column | str) -> Column:
    """target, fragment, label of double-bracket links."""
    found = F.regexp_extract_all(_c(text), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    return F.transform(
        found,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^([^#|]*)", 1)).alias("target"),
            F.nullif(F.trim(F.regexp_extract(x, r"#([^|]*)", 1)), F.lit("")).alias("fragment"),
            F.nullif(F.trim(F.regexp_extract(x, r"\|(.*)$", 1)), F.lit("")).alias("label"),
        ),
    )
