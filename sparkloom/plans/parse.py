"""Recursive-descent parser of the einsum language: ``C[i,j] += A[i,k] * B[k,j]``.

An assignment names a target with its indices, ``=`` or ``op=`` and a scalar
expression over tensor accesses, literals and function calls. Precedence is
Python's: or, and, not, chained comparisons, ``| ^ &``, shifts, sums, products, signs,
power.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"\s*(?:(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?[jJ]?)|(?P<name>[A-Za-z_]\w*)|(?P<op>\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%&|^~<>()\[\],=]))"
)


@dataclass(frozen=True)
class Access:
    name: str
    indices: tuple[str, ...]


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass(frozen=True)
class Program:
    target: str
    indices: tuple[str, ...]
    reduction: str | None
    expression: object


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise SyntaxError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else None

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def take(self, *expected: str) -> str:
        got = self.peek()
        if got is None or (expected and got not in expected):
            raise SyntaxError(f"expected {' or '.join(expected) or 'more'}, found {got!r}")
        self.at += 1
        return got

    def program(self) -> Program:
        if self.kind() != "name":
            raise SyntaxError("a program begins with its target")
        target, indices = self.take(), self.bracketed()
        reduction = None
        if self.peek() != "=" :
            reduction = self.take()
            if reduction in ("<=", ">=", "==", "!="):
                raise SyntaxError(f"{reduction} is no reduction")
        self.take("=")
        out = Program(target, indices, reduction, self.either())
        if self.peek() is not None:
            raise SyntaxError(f"unexpected {self.peek()!r}")
        return out

    def bracketed(self) -> tuple[str, ...]:
        self.take("[")
        out: list[str] = []
        while self.peek() != "]":
            if self.kind() != "name":
                raise SyntaxError(f"{self.peek()!r} is no index")
            out.append(self.take())
            if self.peek() != "]":
                self.take(",")
        self.take("]")
        return tuple(out)

    def chain(self, below, *ops: str):
        left = below()
        while self.peek() in ops:
            op = self.take()
            left = Call(op, (left, below()))
        return left

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negation, "and")

    def negation(self):
        if self.peek() == "not" and self.peek(1) != "(":
            self.take()
            return Call("not", (self.negation(),))
        if self.peek() == "not":
            self.take()
            return Call("not", (self.negation(),))
        return self.comparison()

    def comparison(self):
        terms, ops = [self.bit_or()], []
        while self.peek() in ("==", "!=", "<", "<=", ">", ">="):
            ops.append(self.take())
            terms.append(self.bit_or())
        pairs = [Call(op, (terms[k], terms[k + 1])) for k, op in enumerate(ops)]
        if not pairs:
            return terms[0]
        out = pairs[0]
        for p in pairs[1:]:
            out = Call("and", (out, p))
        return out

    def bit_or(self):
        return self.chain(self.bit_xor, "|")

    def bit_xor(self):
        return self.chain(self.bit_and, "^")

    def bit_and(self):
        return self.chain(self.shift, "&")

    def shift(self):
        return self.chain(self.sum, "<<", ">>")

    def sum(self):
        return self.chain(self.product, "+", "-")

    def product(self):
        return self.chain(self.sign, "*", "/", "//", "%")

    def sign(self):
        if self.peek() in ("+", "-", "~"):
            op = self.take()
            inner = self.sign()
            if isinstance(inner, Literal) and op in "+-" and not isinstance(inner.value, bool):
                return Literal(-inner.value if op == "-" else inner.value)
            return Call(op, (inner,))
        return self.power()

    def power(self):
        base = self.primary()
        if self.peek() == "**":
            self.take()
            return Call("**", (base, self.sign()))
        return base

    def primary(self):
        kind, text = self.kind(), self.peek()
        if kind == "number":
            self.take()
            if text[-1] in "jJ":
                return Literal(complex(text))
            return Literal(float(text) if re.search(r"[.eE]", text) else int(text))
        if text == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        if kind != "name":
            raise SyntaxError(f"unexpected {text!r}")
        self.take()
        if text in ("True", "False"):
            return Literal(text == "True")
        if self.peek() == "[":
            return Access(text, self.bracketed())
        if self.peek() == "(":
            self.take()
            args = []
            while self.peek() != ")":
                args.append(self.either())
                if self.peek() != ")":
                    self.take(",")
            self.take(")")
            return Call(text, tuple(args))
        raise SyntaxError(f"{text} is neither an access nor a call")


def parse(text: str) -> Program:
    return Parser(text).program()
