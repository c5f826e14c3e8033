"""Parameters, signatures and documentation comments of functions, from source lines."""

from __future__ import annotations

import re

PARAMS = (re.compile(r"(?:function\s*[\w$]*\s*|async\s+|^\s*|[=\s])\(([^)]*)\)\s*(?:=>|\{)"), re.compile(r"(?:function\s*\*?\s*[\w$]*|[\w$]+)\s*\(([^)]*)\)"), re.compile(r"(?:=\s*|async\s+)([\w$]+)\s*=>"))
TAG_RETURNS = re.compile(r"@returns?\s+\{([^}]*)\}")


# op: E22
def params_of(body: str) -> list[str]:
    """Names of the first parameter list; defaults go, patterns become `...`."""
    text = next((m[1] for p in PARAMS if (m := p.search(body))), "")
    out = []
    for part in text.split(","):
        name = part.split("=")[0].strip()
        if name:
            out.append("..." if name[0] in "{[" else name)
    return out


# op: E23
def doc_above(lines: list[str], start: int) -> tuple[str | None, str | None]:
    """The first sentence line and the @returns type of the comment that ends within 5 lines above line start (from 1)."""
    end = None
    for k in range(start - 2, max(-1, start - 7), -1):
        text = lines[k].strip()
        if text.endswith("*/"):
            end = k
            break
        if text and not text.startswith("//"):
            return None, None
    if end is None:
        return None, None
    first = next((k for k in range(end, max(-1, end - 31), -1) if lines[k].strip().startswith("/**")), None)
    if first is None:
        return None, None
    comment = lines[first : end + 1]
    plain = [re.sub(r"^/?\*+/?\s?|\*+/$", "", x.strip()).strip() for x in comment]
    said = next((x for x in plain if x and not x.startswith("@")), None)
    returns = TAG_RETURNS.search("\n".join(comment))
    return said, returns[1] if returns else None


def enriched(name: str, start: int, end: int, lines: list[str]) -> dict:
    """body, params, signature, jsdoc and returns of a function at lines start to end."""
    body = "\n".join(lines[start - 1 : end])
    params = params_of(body)
    doc, returns = doc_above(lines, start)
    return {"body": body, "params": params, "jsdoc": doc, "returns": returns, "signature": f"{name}({', '.join(params)})" + (f" → {returns}" if returns else "")}
