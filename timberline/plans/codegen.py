"""Source text of models: SQL, Python and C."""

from __future__ import annotations

import hashlib
import json

from timberline.sources.model import Model

LINK = {True: "1.0 / (1.0 + exp(-2.0 * {f}))", False: "{f}"}


def identifier(name: str) -> str:
    return "".join("_" if c in ". :-" else c for c in name)


def identifiers(m: Model) -> dict[str, str]:
    """A name of its own for each column: those that clean up to one name are numbered."""
    out: dict[str, str] = {}
    for c in m.columns():
        name, n = identifier(c), 1
        while name in out.values():
            n += 1
            name = f"{identifier(c)}_{n}"
        out[c] = name
    return out


def to_sql(m: Model) -> str:
    """An expression over the model's columns (codes for categories) that Spark and other engines read."""
    return LINK[m.positive is not None].format(f="(" + " + ".join(t.sql() for t in m.trees) + ")")


def direction_sets(m: Model) -> dict[tuple[int, ...], int]:
    """The sets of codes that go right, each numbered once, in the order in which trees use them."""
    nodes = (t.nodes[i] for t in m.trees for i in sorted(t.nodes))
    return {codes: n for n, codes in enumerate(dict.fromkeys(tuple(sorted(x.right_codes or [])) for x in nodes if x.fid is not None and x.kind == "cat"))}


def _test(node, c: bool, names: dict[str, str], rights: dict[tuple[int, ...], str]) -> str:
    name = names[node.column]
    if node.kind == "ord":
        return f"{name} > {node.split!r}"
    right = rights[tuple(sorted(node.right_codes or []))]
    return f"{right}({name})" if c else f"{name} in {right}"


def _nested(tree, i: int, depth: int, c: bool, names: dict[str, str], rights: dict[tuple[int, ...], str]) -> list[str]:
    n, pad = tree.nodes[i], "    " * depth
    if n.fid is None:
        return [f"{pad}f += {n.gamma!r}" + ";" * c]
    right, left = (_nested(tree, k, depth + 1, c, names, rights) for k in (2 * i + 1, 2 * i))
    if c:
        return [f"{pad}if ({_test(n, True, names, rights)}) {{", *right, f"{pad}}} else {{", *left, f"{pad}}}"]
    return [f"{pad}if {_test(n, False, names, rights)}:", *right, f"{pad}else:", *left]


def to_python(m: Model, name: str = "eval_by_name") -> str:
    """A module with one function of a dict of column values; missing numbers are 0, unknown categories the anonymous one or an error."""
    out = [f"# model {hashlib.md5(m.to_json().encode()).hexdigest()}", "from math import exp", "", "", "class UnknownCategory(ValueError):", "    pass", "", ""]
    out += [f"CATEGORIES = {m.categories!r}", "", "", "def code(column, value):", "    known = CATEGORIES[column]", "    if value in known:", "        return known.index(value)", "    if None in known:", "        return known.index(None)", "    raise UnknownCategory(column + ': ' + str(value))", "", ""]
    names = identifiers(m)
    rights = {codes: f"RIGHT_{n}" for codes, n in direction_sets(m).items()}
    out += [f"{right} = frozenset({list(codes)!r})" for codes, right in rights.items()] + ["", ""] * bool(rights)
    out.append(f"def {name}(row):")
    for c in m.columns():
        out.append(f"    {names[c]} = " + (f"code({c!r}, row.get({c!r}))" if c in m.categories else f"row.get({c!r}) or 0.0"))
    out.append("    f = 0.0")
    for t in m.trees:
        out += _nested(t, 1, 1, False, names, rights)
    return "\n".join([*out, "    return " + LINK[m.positive is not None].format(f="f"), ""])


def to_c(m: Model, name: str = "f", static: bool = False) -> str:
    """A C function of the model's columns, doubles for numbers and int codes for categories, and for each category column a
    function <name>_code_<column> that finds a text's code: the anonymous category's for unknown ones, or -1."""
    names = identifiers(m)
    args = ", ".join(("int " if c in m.categories else "double ") + names[c] for c in m.columns()) or "void"
    out = [f"/* model {hashlib.md5(m.to_json().encode()).hexdigest()} */", "#include <math.h>", "#include <string.h>", ""]
    for c, known in sorted(m.categories.items()):
        at = names.get(c, identifier(c))
        out += [f"{'static ' * static}int {name}_code_{at}(const char *v) {{"]
        out += [f'    if (v && !strcmp(v, {json.dumps(v, ensure_ascii=False)})) return {i};' for i, v in enumerate(known) if v is not None]
        out += [f"    return {known.index(None) if None in known else -1};", "}", ""]
        out.append(f"/* {at}: " + ", ".join(f"{i} = {'(other)' if v is None else v.replace('*/', '* /')}" for i, v in enumerate(known)) + " */")
    rights = {codes: f"{name}_right_{n}" for codes, n in direction_sets(m).items()}
    out += [f"#define {right}(k) (" + (" || ".join(f"(k) == {k}" for k in codes) or "0") + ")" for codes, right in rights.items()] + [""] * bool(rights)
    out += [f"{'static ' * static}double {name}({args}) {{", "    double f = 0.0;"]
    for t in m.trees:
        out += _nested(t, 1, 1, True, names, rights)
    return "\n".join([*out, "    return " + LINK[m.positive is not None].format(f="f") + ";", "}", ""])
