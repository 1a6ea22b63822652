"""Licence scan (operator 9).

One Aho-Corasick automaton finds identifier tags and notice phrases in a single pass over each text.
The longest well-formed licence expression that follows a tag on its line is the tag's, which a shunting-yard parser turns into
postfix order and evaluates: AND takes the stricter side, OR the freer one, and WITH an exception
that permits linking makes strong copyleft weak.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.session import prepare

#: From the freest to the strictest.
CATEGORIES = ("permissive", "weak copyleft", "strong copyleft", "restricted", "unknown")
TAG = "spdx-license-identifier:"
IDS = {
    **dict.fromkeys("MIT MIT-0 Apache-2.0 Apache-1.1 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 BSL-1.0 PostgreSQL Python-2.0 PSF-2.0 WTFPL NCSA X11 OFL-1.1".split(), 0),
    **dict.fromkeys("LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1".split(), 1),
    **dict.fromkeys("GPL-1.0 GPL-2.0 GPL-3.0 AGPL-1.0 AGPL-3.0 EUPL-1.1 EUPL-1.2 OSL-3.0 CC-BY-SA-3.0 CC-BY-SA-4.0".split(), 2),
    **dict.fromkeys("CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 CC-BY-ND-3.0 BUSL-1.1 SSPL-1.0 LicenseRef-Proprietary".split(), 3),
}
_CC = {
    "by": ("attribution",),
    "by-sa": ("attribution-sharealike", "attribution-share alike", "attribution share alike", "attribution sharealike"),
    "by-nd": ("attribution-noderivatives", "attribution-noderivs", "attribution-no derivatives", "attribution-no derivative works"),
    "by-nc": ("attribution-noncommercial", "attribution-non-commercial", "attribution noncommercial", "attribution non-commercial"),
    "by-nc-sa": ("attribution-noncommercial-sharealike", "attribution-non-commercial-sharealike", "attribution-noncommercial-share alike"),
    "by-nc-nd": ("attribution-noncommercial-noderivatives", "attribution-noncommercial-noderivs", "attribution-non-commercial-noderivatives", "attribution-non-commercial-noderivs"),
}
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Names without a version stand for their family.
IDS |= dict.fromkeys(("Apache", "BSD"), 0) | dict.fromkeys(("LGPL", "MPL", "EPL"), 1) | dict.fromkeys(("GPL", "AGPL"), 2)
IDS |= {f"CC-{k.upper()}{v}": 0 if k == "by" else 2 if k == "by-sa" else 3 for k in _CC for v in ("", *(f"-{v}" for v in _CC_VERSIONS))}
_KNOWN = {i.lower(): i for i in IDS}
LINKING = {"classpath-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "linux-syscall-note", "llvm-exception", "openjdk-assembly-exception-1.0", "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0"}


def _versions(names: list[str], licence: str, versions: tuple[str, ...], forms: tuple[str, ...]) -> dict[str, str]:
    return {f.format(n=n, v=v): f"{licence}-{v if '.' in v else v + '.0'}" for n in names for v in versions for f in forms}


_FORMS = ("{n}, version {v}", "{n} version {v}", "{n} v{v}", "{n} {v}", "version {v} of the {n}", "{n}, v. {v}", "{n} v. {v}", "{n}, v{v}", "{n} (version {v}", "{n} (v{v}")
#: The headers that the Free Software Foundation asks for.
_FSF = tuple(f"{{n}} as published by the free software foundation{x} version {{v}}" for x in (",", ";", ", either", "; either", " either", ""))
_GNU = {"GPL": ("general", ("1", "2", "3", "1.0", "2.0", "3.0")), "LGPL": ("lesser general", ("2.1", "3", "3.0")), "AGPL": ("affero general", ("1", "3", "1.0", "3.0"))}
#: Stands in BSD texts of any number of clauses; two unless others are there.
_BSD_TEXT = "redistribution and use in source and binary forms"
_ISC_TEXT = "this software for any purpose with or without fee is hereby granted"
PHRASES = {
    **{p: "MIT" for p in ("mit license", "mit licence", "permission is hereby granted, free of charge, to any person obtaining a copy")},
    **_versions(["apache license", "apache licence"], "Apache", ("2.0", "1.1"), _FORMS),
    **_versions(["gnu general public license", "gnu general public licence", "gnu gpl"], "GPL", ("1", "2", "3", "1.0", "2.0", "3.0"), _FORMS),
    **_versions(["gnu lesser general public license", "gnu lesser general public licence", "gnu lgpl"], "LGPL", ("2.1", "3", "3.0"), _FORMS),
    **_versions(["gnu affero general public license", "gnu affero general public licence", "gnu agpl"], "AGPL", ("3", "3.0"), _FORMS),
    **{p: k for k, (g, _) in _GNU.items() for n in ("license", "licence") for p in (f"gnu {g} public {n}", f"gnu {k.lower()}", f"{k.lower()} {n}")},
    **{p: i for k, (g, vs) in _GNU.items() for p, i in _versions([f"gnu {g} public license", f"gnu {g} public licence"], k, vs, _FSF).items()},
    **{p: i for k, (_, vs) in _GNU.items() for p, i in _versions([k.lower(), f"gnu {k.lower()}"], k, vs, ("{n}v{v}", "{n} v{v}", "{n}-{v}", "{n} version {v}")).items()},
    **_versions(["gnu affero general public license", "gnu agpl"], "AGPL", ("1", "1.0"), _FORMS),
    **_versions(["gnu library general public license", "gnu library general public licence"], "LGPL", ("2", "2.0"), _FORMS + _FSF),
    **_versions(["gnu lesser general public license", "gnu lesser general public licence", "gnu lgpl"], "LGPL", ("2", "2.0"), _FORMS + _FSF),
    **{f"{n} licen{x}e": k for n, k in (("apache", "Apache"), ("mozilla public", "MPL"), ("eclipse public", "EPL"), ("bsd", "BSD")) for x in "cs"},
    **_versions(["mozilla public license", "mozilla public licence"], "MPL", ("1.1", "2.0"), _FORMS),
    **_versions(["eclipse public license", "eclipse public licence"], "EPL", ("1.0", "2.0"), _FORMS),
    **{f"cc {k} {v}": f"CC-{k.upper()}-{v}" for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")},
    **{f"cc-{k}-{v}": f"CC-{k.upper()}-{v}" for k in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")},
    **{f"cc {k}": f"CC-{k.upper()}" for k in _CC if k != "by"},
    **{f"cc-{k}": f"CC-{k.upper()}" for k in _CC},
    **{f"cc{x}{k}{y}{v}": f"CC-{k.upper()}-{v}" for k in _CC for v in _CC_VERSIONS for x, y in ((" ", " "), ("-", "-"), ("-", " "))},
    **{f"creative commons {n}": f"CC-{k.upper()}" for k, ns in _CC.items() for n in ns},
    **{f"creative commons {n} {x}{v}": f"CC-{k.upper()}-{v}" for k, ns in _CC.items() for n in ns for v in _CC_VERSIONS for x in ("", "version ", "license ", "licence ", "(")},
    **{p: "CC0-1.0" for p in ("cc0 1.0", "cc0-1.0", "cc0", "creative commons zero")},
    **{p: "BSD-3-Clause" for p in ("3-clause bsd license", "bsd 3-clause license", "new bsd license")},
    **{p: "BSD-2-Clause" for p in ("2-clause bsd license", "bsd 2-clause license", "simplified bsd license")},
    _BSD_TEXT: "BSD-2-Clause",
    **{p: "BSD-3-Clause" for p in ("may be used to endorse or promote products derived from this software", "bsd-3-clause", "bsd-3-clause license")},
    **{p: "BSD-4-Clause" for p in ("all advertising materials mentioning features or use of this software",)},
    "bsd-2-clause": "BSD-2-Clause",
    **{p: "ISC" for p in ("isc license", "isc licence", "permission to use, copy, modify, and/or distribute", f"permission to use, copy, modify, and distribute {_ISC_TEXT}")},
    f"permission to use, copy, modify, and/or distribute {_ISC_TEXT}.": "0BSD",
    **{p: "Unlicense" for p in ("released into the public domain", "the unlicense")},
    **{p: "LicenseRef-Proprietary" for p in ("all rights reserved", "proprietary and confidential")},
}

_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None if the expression is ill-formed."""
    out, waiting, operand = [], [], True
    for t in _TOKEN.findall(expression.lower()):
        if t == "(":
            if not operand:
                return None
            waiting.append(t)
        elif t == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in _BINDS:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = True
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


_NEXT = re.compile(r"[ \t]*(\(|\)|[a-z0-9]+(?:[.:+-]+[a-z0-9]+)*\+?)")
_OPENING = re.compile(r"[ \"'`<>=]*")


def expression_at(line: str, at: int = 0) -> tuple[int, int]:
    """(begin, end) of the longest well-formed expression that begins at `at`; without one, of the tokens that could have begun it.

    A plain word that is no known id, stands after an operator and is followed by another word is prose.
    """
    begin = at = _OPENING.match(line, at).end()
    depth, operand, waiting, goods = 0, True, "", []
    while m := _NEXT.match(line, at):
        t = m[1]
        if t == "(" or t not in _BINDS and t != ")":
            if not operand:
                while len(goods) > 1 and goods[-1][1] and t != "(":
                    goods.pop()
                break
            depth, operand = depth + (t == "("), t == "("
        elif t == ")":
            if operand or not depth:
                break
            depth -= 1
        elif operand:
            break
        else:
            operand, waiting = True, t
        at = m.end()
        if not operand and not depth:
            goods.append((at, bool(waiting) and t.isalpha() and _plain(t) not in IDS))
    return begin, goods[-1][0] if goods else at


def _plain(name: str) -> str:
    """The id without the marks for later versions."""
    name = name.removesuffix("+").removesuffix("-or-later").removesuffix("-only")
    return _KNOWN.get(name, name)


def evaluate(order: list[str] | None) -> tuple[int, list[str]]:
    """(category, ids) of an expression in postfix order; an ill-formed one is unknown and has no ids."""
    if order is None:
        return len(CATEGORIES) - 1, []
    stack: list[tuple[int, list[str], str]] = []
    for t in order:
        if t not in _BINDS:
            stack.append((IDS.get(_plain(t), len(CATEGORIES) - 1), [_plain(t)], t))
            continue
        (b, right, name), (a, left, _) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((1 if a == 2 and name in LINKING else a, left, ""))
        else:
            stack.append(((max if t == "and" else min)(a, b), left + right, ""))
    return stack[0][0], stack[0][1]


_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    if not _automata:
        a = ahocorasick.Automaton()
        for p, licence in [(TAG, ""), *PHRASES.items()]:
            a.add_word(p, (len(p), licence, p == _BSD_TEXT))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


#: A line's end with the marks of comments that begin the next one.
_RUN = re.compile(r" *\n[ */#;%]*| {2,}")
_BROKEN = re.compile(r"  | \n|\n[ */#;%]")
_BLANKS = str.maketrans("\t\r\f\v\xa0", "     ")


def scan(text: str) -> tuple[list[str], str | None, int, int | None]:
    """(ids, expression of all tags, notices, category or None if the text names no licence)."""
    lines = text.lower().translate(_BLANKS)
    if _BROKEN.search(lines):
        lines = _RUN.sub(lambda m: "\n" if "\n" in m[0] else " ", lines)
    flat = lines.replace("\n", " ")
    found = []
    for end, (size, licence, bsd) in _automaton().iter(flat):
        begin, end = end + 1 - size, end + 1
        if begin and flat[begin - 1].isalnum() or licence and end < len(flat) and (flat[end].isalnum() or flat[end : end + 2].startswith(".") and flat[end + 1 : end + 2].isdigit()):
            continue
        while found and found[-1][0] >= begin:  # a longer one has it all
            found.pop()
        if not (found and found[-1][1] >= end):
            found.append((begin, end, licence, bsd))
    if not found:
        return [], None, 0, None
    ids, tags, category, notices, past = set(), [], 0, 0, 0
    clauses = any(licence in ("BSD-3-Clause", "BSD-4-Clause") for _, _, licence, _ in found)
    for begin, end, licence, bsd in found:
        if begin < past:  # inside a tag's expression
            continue
        if licence:
            if not (bsd and clauses):
                ids.add(licence)
            category, notices = max(category, IDS[licence]), notices + 1
            continue
        start, past = expression_at(lines, end)
        tag = lines[start:past]
        rank, own = evaluate(postfix(tag))
        ids.update(own)
        tags.append(tag)
        category = max(category, rank)
    return sorted(ids), " and ".join(f"({t})" if len(tags) > 1 else t for t in tags) or None, notices, category


_OUT = pa.schema([("doc_id", pa.int64()), ("licenses", pa.list_(pa.string())), ("expression", pa.string()), ("n_notices", pa.int64()), ("category", pa.string())])


def _scan_rows(batches):
    for rows in batches:
        found = [([], None, 0, None) if t is None else scan(t) for t in rows.column(1).to_pylist()]
        ids, tags, notices, category = zip(*found) if found else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, _OUT.field(1).type), pa.array(tags, pa.string()), pa.array(np.array(notices, np.int64)), pa.array([None if c is None else CATEGORIES[c] for c in category], pa.string())], schema=_OUT)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, expression, n_notices, category) of every row; nothing is shuffled.

    Case and the kind and number of blanks don't matter, and a notice may run over a line's end.
    Matches begin and end at words; of overlapping ones the longest counts. All tags and notices of
    a text hold together, so its category is the strictest of theirs; an ill-formed expression is
    "unknown". A null, empty or licence-free text has no licences, no expression, 0 notices and a
    null category. A null doc_id stays null, rows that stand twice come out twice, an empty table
    gives no rows. Other columns are not read.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan_rows, "doc_id long, licenses array<string>, expression string, n_notices long, category string")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
