"""Items of Rust sources: kinds, names, spans, visibility and documentation of what a file declares.

A file is one row, so its items are found where the row is; files never meet.
Comments, strings and character literals are blanked out first, byte for
byte, so declarations are matched in what is left and every offset holds in
the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_SKIPPED = re.compile(
    rb"//[^\n]*|/\*|b?r(#*)\"|b?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'|'[^\W\d]\w*(?!')",
    re.S,
)
_COMMENT_EDGE = re.compile(rb"/\*|\*/")
_ITEM = re.compile(
    rb"(?P<vis>pub(?:\s*\([^()]*\))?\s+)?"
    rb"(?:(?P<fn>(?:(?:default|const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn)\s+(?P<fn_name>(?:r#)?\w+)"
    rb"|(?P<kind>struct|enum|union|trait|(?:unsafe\s+|auto\s+)*trait|mod|type)\s+(?P<name>(?:r#)?\w+)"
    rb"|(?P<value>const|static(?:\s+mut)?)\s+(?P<value_name>(?:r#)?\w+)\s*:"
    rb"|(?P<impl>(?:unsafe\s+)?impl)\b"
    rb"|(?P<macro>macro_rules\s*!)\s*(?P<macro_name>\w+))"
)
_ATTRIBUTE = re.compile(rb"#\s*!?\s*\[")
_WORD = re.compile(rb"[A-Za-z_]\w*")

ITEM = pa.schema(
    [
        ("item_kind", pa.string()), ("item_name", pa.string()), ("path", pa.string()), ("signature", pa.string()), ("doc_markdown", pa.string()),
        ("visibility", pa.string()), ("attrs", pa.list_(pa.string())), ("byte_start", pa.int64()), ("byte_len", pa.int64()), ("line_start", pa.int32()), ("line_end", pa.int32()),
    ]
)


def _blanked(raw: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The source with comments and literals as blanks, and where comments stand."""
    out, comments, at = bytearray(raw), [], 0
    while m := _SKIPPED.search(raw, at):
        start, end = m.span()
        text = m[0]
        if text.startswith(b"/*"):
            depth = 1
            while depth and (e := _COMMENT_EDGE.search(raw, end)):
                depth += 1 if e[0] == b"/*" else -1
                end = e.end()
            end = len(raw) if depth else end
        elif m[1] is not None:  # a raw string ends at its own mark
            close = raw.find(b'"' + m[1], end)
            end = len(raw) if close < 0 else close + 1 + len(m[1])
        elif text.startswith(b"'") and not text.endswith(b"'"):
            at = end  # a lifetime
            continue
        if text.startswith((b"//", b"/*")):
            comments.append((start, end))
        out[start:end] = re.sub(rb"[^\n]", b" ", raw[start:end])
        at = end
    return bytes(out), comments


def _block_end(code: bytes, at: int, opened: bytes, closed: bytes) -> int:
    """Where the block that begins at `at` ends."""
    depth, edge = 0, re.compile(b"[" + re.escape(opened) + re.escape(closed) + b"]")
    for m in edge.finditer(code, at):
        depth += 1 if m[0] == opened else -1
        if not depth:
            return m.end()
    return len(code)


def _head_end(code: bytes, at: int, limit: int) -> tuple[int, bool]:
    """Where an item's head ends and whether a block follows; brackets within the head are passed over."""
    i = at
    while i < limit:
        c = code[i : i + 1]
        if c == b"{":
            return i, True
        if c == b";":
            return i, False
        if c in (b"(", b"["):
            i = _block_end(code, i, c, b")" if c == b"(" else b"]")
            continue
        i += 1
    return limit, False


def _doc_line(raw: bytes) -> str | None:
    """The text of an outer documentation comment, None if it is another comment."""
    s = raw.decode("utf-8", "replace").replace("\r\n", "\n")
    if s.startswith("///") and not s.startswith("////"):
        return s[3:].rstrip("\r").removeprefix(" ")
    if s.startswith("/**") and not s.startswith(("/***", "/**/")):
        lines = s[3:].removesuffix("*/").split("\n")
        return "\n".join(re.sub(r"^\s*\* ?", "", x) for x in lines).strip("\n ")
    return None


def _before(raw: bytes, code: bytes, comments: list[tuple[int, int]], floor: int, at: int) -> tuple[int, list[str], list[str]]:
    """Start of an item's documentation and attributes, its documentation lines and attributes."""
    ends = [e for _, e in comments]
    start, docs, attrs = at, [], []
    while True:
        i = start
        while i > floor and raw[i - 1 : i].isspace():
            i -= 1
        k = bisect_right(ends, i) - 1
        if k >= 0 and comments[k][0] >= floor and not raw[comments[k][1] : i].strip():
            text = _doc_line(raw[comments[k][0] : comments[k][1]])
            if text is not None:
                docs.append(text)
            start = comments[k][0]
            if text is None and not docs and not attrs:
                return at, docs[::-1], attrs[::-1]
            continue
        if i > floor and code[i - 1 : i] == b"]":
            depth, j = 0, i
            while j > floor:
                j -= 1
                depth += {b"]": 1, b"[": -1}.get(code[j : j + 1], 0)
                if not depth:
                    break
            h = j
            while h > floor and code[h - 1 : h].isspace():
                h -= 1
            if code[h - 1 : h] == b"#":
                inner = raw[h - 1 : i].decode("utf-8", "replace")
                said = re.fullmatch(r'#\s*\[\s*doc\s*=\s*"((?:[^"\\]|\\.)*)"\s*\]', inner, re.S)
                if said:
                    docs.append(said[1].replace('\\"', '"').removeprefix(" "))
                else:
                    attrs.append(inner)
                start = h - 1
                continue
        return start, docs[::-1], attrs[::-1]


def parse_items(text: str | None) -> list[dict]:
    """Items of a source in text order, those of inline modules, impls and traits included, none of function bodies.

    Null and empty sources hold none. `path` is the item's path within the
    file; of an impl it is the type's name.
    """
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    code, comments = _blanked(raw)
    lines = [m.start() for m in re.finditer(rb"\n", raw)]
    out: list[dict] = []
    stack = [(0, len(raw), (), "")]
    while stack:
        at, limit, path, within = stack.pop()
        floor = at
        while at < limit:
            c = code[at : at + 1]
            if c == b"{":
                at = floor = _block_end(code, at, b"{", b"}")
                continue
            if not (c.isalpha() or c == b"_") or (at and (code[at - 1 : at].isalnum() or code[at - 1 : at] in (b"_", b"#", b"$"))):
                if c in (b";", b"}"):
                    floor = at + 1
                at = at + 1 if (skip := _ATTRIBUTE.match(code, at)) is None else _block_end(code, skip.end() - 1, b"[", b"]")
                continue
            m = _ITEM.match(code, at, limit)
            if not m or (m["vis"] is None and re.match(rb"(?:const|static)\s+(?:fn|unsafe|async|extern)\b", m[0]) and not m["fn"]):
                at = _WORD.match(code, at).end() if _WORD.match(code, at) else at + 1
                continue
            kind = "fn" if m["fn"] else "impl" if m["impl"] else "macro" if m["macro"] else (m["value"] or m["kind"]).split()[-1 if m["kind"] else 0].decode()
            name = (m["fn_name"] or m["name"] or m["value_name"] or m["macro_name"] or b"").decode().removeprefix("r#")
            head, block = _head_end(code, m.end(), limit)
            end = _block_end(code, head, b"{", b"}") if block else min(head + 1, limit)
            if kind == "static" or kind == "const" or (kind == "type" and block):
                stop = code.find(b";", m.end(), limit)
                if block and stop > end - 1:
                    end = stop + 1
            inner = path
            if kind == "impl":
                target = re.sub(r"<[^<>]*>", "", _flat(raw[m.end() : head].decode("utf-8", "replace")))
                target = re.split(r"\bwhere\b", re.split(r"\bfor\b", target)[-1])[0].strip(" &!")
                name = re.split(r"::", target)[-1].strip() if target else ""
                inner = (*path, name)
            elif kind in ("mod", "trait"):
                inner = (*path, name)
            start, docs, attrs = _before(raw, code, comments, floor, at)
            exported = kind != "macro" or any("macro_export" in a for a in attrs)
            if exported and not (kind == "mod" and not block and within):
                out.append(
                    {
                        "item_kind": kind, "item_name": name, "path": "::".join((*path, name)), "signature": " ".join(raw[at:head].decode("utf-8", "replace").split()),
                        "doc_markdown": "\n".join(docs) if docs else None, "visibility": "pub" if m["vis"] and b"(" not in m["vis"] else (m["vis"] or b"private").decode().strip(),
                        "attrs": attrs, "byte_start": start, "byte_len": end - start, "line_start": bisect_right(lines, start - 1) + 1, "line_end": bisect_right(lines, end - 1) + 1,
                    }
                )
            if block and kind in ("mod", "impl", "trait"):
                stack.append((end, limit, path, within))
                stack.append((head + 1, end - 1, inner, kind))
                break
            at = floor = end
    return sorted(out, key=lambda x: x["byte_start"])


def _flat(s: str) -> str:
    """Without generic arguments, however deep."""
    while (new := re.sub(r"<[^<>]*>", "", s.replace("->", "  "))) != s:
        s = new
    return s


def source_items(files: DataFrame, content: str = "content", keep: tuple[str, ...] = ("file_id",)) -> DataFrame:
    """The kept columns and the columns of ITEM for every item of every file."""
    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields}

    def run(batches):
        for b in batches:
            who, found = [], []
            for i, t in enumerate(b.column("content").to_pylist()):
                got = parse_items(t)
                who += [i] * len(got)
                found += got
            rows = pa.RecordBatch.from_pylist(found, schema=ITEM)
            pick = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pick) for k in keep), *rows.columns], [*keep, *ITEM.names])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep]) + (
        ", item_kind string, item_name string, path string, signature string, doc_markdown string, visibility string, attrs array<string>, byte_start bigint, byte_len bigint, line_start int, line_end int"
    )
    return files.select(*keep, F.col(content).alias("content")).mapInArrow(run, schema)
