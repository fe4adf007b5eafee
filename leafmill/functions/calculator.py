"""Stack programs and sampled, exponential and stitched functions, compiled to columns.

A program is compiled by running it on a stack of columns: operators that move
values vanish, arithmetic becomes expressions, a two-way branch becomes a CASE
for each value on which the branches differ. Counts (of copy, index and roll)
must be known when compiling; a program in which they aren't is run row by row
by Machine instead, inside a pandas UDF.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a program: steps, values on the stack, nesting.
STEPS, STACK, NESTING = 100_000, 1_000, 32


class ProgramError(ValueError):
    pass


def parse(source: str) -> list:
    """Words, numbers as floats and nested lists of the one block that a program is."""
    words = re.findall(r"[{}]|[^\s{}]+", source)
    if not words or words[0] != "{" or words[-1] != "}":
        raise ProgramError("a program is one block")
    stack: list[list] = [[]]
    for w in words:
        if w == "{":
            stack.append([])
            if len(stack) > NESTING + 1:
                raise ProgramError("blocks are nested too deep")
        elif w == "}":
            if len(stack) < 2:
                raise ProgramError("a block ends that never began")
            done = stack.pop()
            stack[-1].append(done)
        elif w in OPERATORS:
            stack[-1].append(w)
        else:
            try:
                stack[-1].append(float(w))
            except ValueError:
                raise ProgramError(f"unknown word {w}") from None
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ProgramError("a program is one block")
    return stack[0][0]


def _long(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")


def _trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def _divide(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), float("nan")).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _whole(op):
    def run(a: Column, b: Column) -> Column:
        x, y = _long(a), _long(b)
        return F.when(y == 0, F.lit(0)).otherwise(op(x, F.when(y == 0, F.lit(1)).otherwise(y))).cast("double")

    return run


def _angle(y: Column, x: Column) -> Column:
    degrees = F.degrees(F.atan2(y, x))
    return F.when(degrees < 0, degrees + 360).otherwise(degrees)


def _shift(a: Column, by: Column) -> Column:
    x, n = _long(a), F.least(F.greatest(_long(by), F.lit(-63)), F.lit(63)).cast("int")
    left = F.call_function("shiftleft", x, F.greatest(n, F.lit(0)))
    return F.when(n >= 0, left).otherwise(F.call_function("shiftright", x, F.greatest(-n, F.lit(0)))).cast("double")


NUMERIC = {
    "abs": F.abs, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": lambda a: F.round(a),
    "truncate": _trunc, "cvi": _trunc, "cvr": lambda a: a, "neg": lambda a: -a, "sqrt": F.sqrt, "sin": lambda a: F.sin(F.radians(a)),
    "cos": lambda a: F.cos(F.radians(a)), "ln": F.ln, "log": F.log10,
}
BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _divide, "exp": F.pow, "atan": _angle,
    "idiv": _whole(lambda x, y: F.call_function("div", x, y)), "mod": _whole(lambda x, y: x % y), "bitshift": _shift,
}
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
LOGIC = {"and": (lambda a, b: a & b, "bitwiseAND"), "or": (lambda a, b: a | b, "bitwiseOR"), "xor": (lambda a, b: a != b, "bitwiseXOR")}
MOVES = ("pop", "dup", "exch", "copy", "index", "roll")
OPERATORS = frozenset([*NUMERIC, *BINARY, *COMPARE, *LOGIC, *MOVES, "not", "true", "false", "if", "ifelse"])


@dataclass
class Value:
    """A column on the stack (none for a count of Machine), whether it is a truth value, and its number if that is known."""

    column: Column | None
    truth: bool = False
    number: float | None = None

    def numeric(self) -> Column:
        return self.column.cast("int").cast("double") if self.truth else self.column


def _number(x: float) -> Value:
    return Value(F.lit(float(x)), number=float(x))


def _pop(stack: list, n: int = 1) -> list:
    if len(stack) < n:
        raise ProgramError("the stack is empty")
    out = stack[-n:] if n else []
    del stack[len(stack) - n :]
    return out


def _count(stack: list) -> int:
    (v,) = _pop(stack)
    if v.number is None:
        raise ProgramError("a count that depends on the input")
    return int(v.number)


def _move(word: str, stack: list) -> None:
    if word == "pop":
        _pop(stack)
    elif word == "dup":
        stack += _pop(stack) * 2
    elif word == "exch":
        a, b = _pop(stack, 2)
        stack += [b, a]
    elif word == "copy":
        n = max(0, _count(stack))
        if n > len(stack):
            raise ProgramError("the stack is empty")
        stack += stack[len(stack) - n :]
    elif word == "index":
        n = max(0, _count(stack))
        if n >= len(stack):
            raise ProgramError("the stack is empty")
        stack.append(stack[-1 - n])
    else:
        by = _count(stack)
        n = max(0, _count(stack))
        part = _pop(stack, n)
        cut = -by % n if n else 0
        stack += part[cut:] + part[:cut]


def _run(block: list, stack: list) -> None:
    for i, word in enumerate(block):
        if isinstance(word, float):
            stack.append(_number(word))
        elif isinstance(word, list):
            if not (block[i + 1 : i + 2] == ["if"] or block[i + 2 : i + 3] == ["ifelse"] or block[i + 1 : i + 2] == ["ifelse"]):
                raise ProgramError("a block outside a branch")
        elif word in ("if", "ifelse"):
            parts = block[i - 1 : i] if word == "if" else block[max(0, i - 2) : i]
            if len(parts) != (1 if word == "if" else 2) or not all(isinstance(p, list) for p in parts):
                raise ProgramError("a branch without its blocks")
            (test,) = _pop(stack)
            yes, no = list(stack), list(stack)
            _run(parts[0], yes)
            if word == "ifelse":
                _run(parts[1], no)
            if len(yes) != len(no):
                raise ProgramError("branches that leave unlike stacks")
            stack[:] = [a if a is b else _choice(test, a, b) for a, b in zip(yes, no, strict=True)]
        elif word in MOVES:
            _move(word, stack)
        elif word in ("true", "false"):
            stack.append(Value(F.lit(word == "true"), True))
        elif word == "not":
            (v,) = _pop(stack)
            stack.append(Value(~v.column, True) if v.truth else Value((-_long(v.column) - 1).cast("double")))
        elif word in NUMERIC:
            (v,) = _pop(stack)
            known = -v.number if word == "neg" and v.number is not None else None
            stack.append(Value(NUMERIC[word](v.numeric()), number=known))
        else:
            a, b = _pop(stack, 2)
            if word in BINARY:
                stack.append(Value(BINARY[word](a.numeric(), b.numeric())))
            elif word in COMPARE:
                stack.append(Value(COMPARE[word](a.numeric(), b.numeric()), True))
            elif a.truth and b.truth:
                stack.append(Value(LOGIC[word][0](a.column, b.column), True))
            else:
                stack.append(Value(getattr(_long(a.numeric()), LOGIC[word][1])(_long(b.numeric())).cast("double")))
        if len(stack) > STACK:
            raise ProgramError("the stack is full")


def _choice(test: Value, a: Value, b: Value) -> Value:
    yes = test.column if test.truth else test.column != 0
    if a.truth != b.truth:
        raise ProgramError("branches that leave unlike kinds")
    return Value(F.when(yes, a.column).otherwise(b.column), a.truth)


def clip(values: list[Column], limits: list[float]) -> list[Column]:
    """Values within pairs of limits in either order; as they are if there are too few limits."""
    if len(limits) < 2 * len(values):
        return values
    pair = lambda i: sorted(limits[2 * i : 2 * i + 2])
    return [F.least(F.greatest(v, F.lit(float(pair(i)[0]))), F.lit(float(pair(i)[1]))) for i, v in enumerate(values)]


def program(source: str, inputs: list[Column], domain: list[float], range_: list[float]) -> list[Column]:
    """The last outputs of a program, as many as range_ has pairs, within range_."""
    if len(inputs) < len(domain) // 2 or not domain:
        raise ProgramError("too few inputs")
    stack = [Value(v) for v in clip([x.cast("double") for x in inputs[: len(domain) // 2]], domain)]
    _run(parse(source), stack)
    if any(v.truth for v in stack):
        raise ProgramError("a truth value is left over")
    n = len(range_) // 2
    if n > len(stack):
        raise ProgramError("too few outputs")
    return clip([v.column for v in stack[len(stack) - n :]], range_)


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.lit(float(y0)) if x1 == x0 else y0 + (x - x0) * ((y1 - y0) / (x1 - x0))


def exponential(x: Column, domain: list[float], c0: list[float], c1: list[float], n: float) -> list[Column]:
    """c0 + x^n (c1 - c0), with the sign of x kept."""
    (x,) = clip([x.cast("double")], domain)
    t = x if n == 1 else F.pow(F.abs(x), F.lit(float(n))) * F.signum(x)
    return [a + t * (b - a) for a, b in zip(c0, c1, strict=True)]


def stitched(x: Column, domain: list[float], parts: list, bounds: list[float], encode: list[float]) -> list[Column]:
    """The part whose bounds hold x (a bound belongs to the next), after its encoding; parts: functions of a column."""
    (x,) = clip([x.cast("double")], domain)
    edges = [domain[0], *bounds, domain[1]]
    each = [f(interpolate(x, edges[k], edges[k + 1], encode[2 * k], encode[2 * k + 1])) for k, f in enumerate(parts)]
    out = []
    for values in zip(*each, strict=True):
        pick = values[-1]
        for bound, v in reversed(list(zip(bounds, values[:-1], strict=True))):
            pick = F.when(x < bound, v).otherwise(pick)
        out.append(pick)
    return out


def sampled(x: Column, domain: list[float], table: list[float], size: int, depth: int, encode: list[float], decode: list[float]) -> Column:
    """A sampled function of one input, linear between samples."""
    (x,) = clip([x.cast("double")], domain)
    at = F.least(F.greatest(interpolate(x, domain[0], domain[1], *encode), F.lit(0.0)), F.lit(float(size - 1)))
    low = F.floor(at).cast("int")
    values = F.array(*(F.lit(float(v)) for v in table))
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, F.lit(size)))
    return interpolate(a + (b - a) * (at - low), 0.0, float(2**depth - 1), *decode)


class Machine:
    """Runs a program on numbers, for those that can't be compiled."""

    UNARY = {
        "abs": abs, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(abs(a) + 0.5) * (1 if a >= 0 else -1), "truncate": math.trunc,
        "cvi": math.trunc, "cvr": float, "neg": lambda a: -a, "sqrt": lambda a: math.sqrt(a) if a >= 0 else math.nan,
        "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)),
        "ln": lambda a: math.log(a) if a > 0 else -math.inf if a == 0 else math.nan, "log": lambda a: math.log10(a) if a > 0 else -math.inf if a == 0 else math.nan,
    }

    def __init__(self, source: str):
        self.block, self.steps = parse(source), 0

    def run(self, inputs: list[float]) -> list[float]:
        stack: list = [float(x) for x in inputs]
        self.steps = 0
        self._run(self.block, stack)
        if any(isinstance(v, bool) for v in stack):
            raise ProgramError("a truth value is left over")
        return stack

    def _run(self, block: list, stack: list) -> None:
        for i, word in enumerate(block):
            self.steps += 1
            if self.steps > STEPS or len(stack) > STACK:
                raise ProgramError("the program is too long")
            if isinstance(word, list):
                continue
            if isinstance(word, float):
                stack.append(word)
            elif word in ("if", "ifelse"):
                parts = block[i - 1 : i] if word == "if" else block[max(0, i - 2) : i]
                test = stack.pop()
                if test:
                    self._run(parts[0], stack)
                elif word == "ifelse":
                    self._run(parts[1], stack)
            elif word in MOVES:
                if word in ("copy", "index", "roll"):
                    counts = 2 if word == "roll" else 1
                    stack[-counts:] = [Value(None, number=float(v)) for v in stack[-counts:]]
                _move(word, stack)
            elif word in ("true", "false"):
                stack.append(word == "true")
            elif word == "not":
                v = stack.pop()
                stack.append(not v if isinstance(v, bool) else float(~int(v)))
            elif word in self.UNARY:
                stack.append(float(self.UNARY[word](stack.pop())))
            else:
                b, a = stack.pop(), stack.pop()
                stack.append(self._binary(word, a, b))

    def _binary(self, word: str, a, b):
        if word in COMPARE:
            return bool(COMPARE[word](float(a), float(b)))
        if word in LOGIC:
            if isinstance(a, bool) and isinstance(b, bool):
                return {"and": a and b, "or": a or b, "xor": a != b}[word]
            x, y = int(a), int(b)
            return float({"and": x & y, "or": x | y, "xor": x ^ y}[word])
        if word in ("idiv", "mod"):
            x, y = int(a), int(b)
            q = 0 if y == 0 else abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
            return float(q if word == "idiv" else 0 if y == 0 else x - q * y)
        if word == "bitshift":
            x, n = int(a), int(b)
            return float(x << min(n, 63) if n >= 0 else x >> min(-n, 63))
        if word == "div":
            return a / b if b else math.nan if a == 0 else math.copysign(math.inf, a)
        if word == "atan":
            return math.degrees(math.atan2(a, b)) % 360
        return {"add": a + b, "sub": a - b, "mul": a * b}[word] if word != "exp" else float(a**b)

