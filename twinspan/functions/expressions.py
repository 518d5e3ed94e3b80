"""The filter-expression language of homology tables, compiled to a Column.

`length >= 20 && seq_sim > 0.95 || strand == '-'`: names are the table's columns or keys of its info map
(looked up in upper case), `&&`, `||`, `!`, `and`, `or`, `not`, comparisons (chained too), arithmetic, `in`,
conditionals and a few functions. A name's type is settled where it is used: beside a string it is one, else a
number; a value that isn't one makes the comparison null, and the row is not taken.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMNS = ("chrom1", "start1", "end1", "strand", "chrom2", "start2", "end2")
TEXT_COLUMNS = ("chrom1", "chrom2", "strand")
ALIASES = {"seq_sim": "SS", "length": "ALENGTH"}
_STRINGS = re.compile(r"('[^']*'|\"[^\"]*\")")
_BINARY = {ast.Add: Column.__add__, ast.Sub: Column.__sub__, ast.Mult: Column.__mul__, ast.Div: Column.__truediv__, ast.Mod: Column.__mod__, ast.Pow: Column.__pow__}
_COMPARE = {ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__, ast.Eq: Column.__eq__, ast.NotEq: Column.__ne__}
_FUNCTIONS = {"abs": F.abs, "min": F.least, "max": F.greatest, "int": lambda c: c.cast("bigint"), "float": lambda c: c.cast("double"), "str": lambda c: c.cast("string"), "sqrt": F.sqrt, "log": F.ln}


def parse_info(info: Column) -> Column:
    """`key=value;...` as a map; a key without `=` has a null value, the last of repeated keys counts."""
    last_first = F.reverse(F.filter(F.split(info, ";"), lambda x: x != ""))
    keys = F.transform(last_first, lambda x: F.substring_index(x, "=", 1))
    entries = F.filter(
        F.transform(last_first, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("key"), F.nullif(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1), F.lit("")).alias("value"), i.alias("i"))),
        lambda e: F.array_position(keys, e["key"]) == e["i"] + 1,
    )
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def info_value(info: Column, key: str) -> Column:
    """parse_info()[key] without a map: the text behind the last `key=`, null if the key comes again behind it, without `=`."""
    all_of = F.concat(F.lit(";"), info, F.lit(";"))
    rest = F.substring_index(all_of, f";{key}=", -1)
    return F.when(F.contains(all_of, F.lit(f";{key}=")) & ~F.contains(rest, F.lit(f";{key};")), F.nullif(F.substring_index(rest, ";", 1), F.lit("")))


class _Compiler:
    def __init__(self, info: str, as_text: bool):
        self.info, self.as_text = info, as_text

    def found(self, key: str) -> Column:
        if not self.as_text:
            return F.try_element_at(F.col(self.info), F.lit(key))
        if not key.isidentifier():
            raise ValueError(f"no such key: {key!r}")
        return F.nullif(F.regexp_extract(F.col(self.info), rf"(?s)^(?:.*;)?{key}=([^;]*)", 1), F.lit(""))

    def text(self, node: ast.AST) -> bool:
        if isinstance(node, ast.Constant):
            return isinstance(node.value, str)
        if isinstance(node, ast.Name):
            return node.id.lower() in TEXT_COLUMNS
        if isinstance(node, ast.Call):
            return getattr(node.func, "id", "") == "str"
        return isinstance(node, (ast.Tuple, ast.List)) and any(map(self.text, node.elts))

    def value(self, node: ast.AST, text: bool) -> Column:
        if isinstance(node, ast.Constant):
            if not isinstance(node.value, (str, int, float, bool)):
                raise ValueError(f"no such value: {node.value!r}")
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            name = node.id.lower()
            if name in ("true", "false"):
                return F.lit(name == "true")
            if name in COLUMNS:
                return F.col(name)
            found = self.found(ALIASES.get(name, name.upper()))
            return found if text else found.try_cast("double")
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](self.value(node.left, False), self.value(node.right, False))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -self.value(node.operand, False)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and not node.keywords:
            return _FUNCTIONS[node.func.id](*(self.value(a, node.func.id == "str") for a in node.args))
        if isinstance(node, (ast.BoolOp, ast.Compare, ast.IfExp)) or isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return self.condition(node)
        raise ValueError(f"not part of the language: {ast.dump(node)}")

    def condition(self, node: ast.AST) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.condition(v) for v in node.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(node.op, ast.And) else out | p
            return out
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~self.condition(node.operand)
        if isinstance(node, ast.IfExp):
            text = self.text(node.body) or self.text(node.orelse)
            return F.when(self.condition(node.test), self.value(node.body, text)).otherwise(self.value(node.orelse, text)).cast("boolean")
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            text = any(map(self.text, sides))
            out = None
            for op, a, b in zip(node.ops, sides, sides[1:]):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(b, (ast.Tuple, ast.List)):
                    one = self.value(a, text).isin([e.value for e in b.elts if isinstance(e, ast.Constant)])
                    one = ~one if isinstance(op, ast.NotIn) else one
                elif type(op) in _COMPARE:
                    one = _COMPARE[type(op)](self.value(a, text), self.value(b, text))
                else:
                    raise ValueError(f"no such comparison: {ast.dump(op)}")
                out = one if out is None else out & one
            return out
        if isinstance(node, (ast.Constant, ast.Name, ast.Call, ast.BinOp)):
            return self.value(node, False).cast("boolean")
        raise ValueError(f"not part of the language: {ast.dump(node)}")


def compile_expression(text: str, info: str = "info", as_text: bool = False) -> Column:
    """A boolean Column. Only what is named above is accepted; anything else raises ValueError. as_text: info is
    `key=value;...` text, out of which the few keys that the expression names are read without making a map."""
    parts = _STRINGS.split(text)
    parts[::2] = [re.sub(r"!(?!=)", " not ", p.replace("&&", " and ").replace("||", " or ")) for p in parts[::2]]
    try:
        tree = ast.parse(" ".join("".join(parts).split()), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"cannot read the expression {text!r}: {e.msg}") from e
    return _Compiler(info, as_text).condition(tree.body)
