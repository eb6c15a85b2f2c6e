"""JVM class files: declarations, references and body hashes from their bytes.

A small reader of the class-file format as the JVM specification describes it, run by
``mapInArrow`` over a binary column. ``simple_class`` writes small classes for tests.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the class-file format: sizes of constant-pool entries by tag; operand bytes of instructions by opcode.
POOL_SIZE = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
ONE_BYTE = {16, 18, *range(21, 26), *range(54, 59), 169, 188}
JUMPS, FAR_JUMPS = {*range(153, 169), 198, 199}, {200, 201}
TWO_BYTES = {17, 19, 20, 132, *JUMPS, *range(178, 185), 187, 189, 192, 193}
FOUR_BYTES = {185, 186, *FAR_JUMPS}
LAMBDAS = "java/lang/invoke/LambdaMetafactory"
KINDS = {178: "get", 179: "put", 180: "get", 181: "put", 182: "call", 183: "call", 184: "call", 185: "call", 187: "new", 189: "type", 192: "type", 193: "type"}


class ClassFile:
    """Names, flags, members and, with code, the references of each method."""

    def __init__(self, data: bytes, with_code: bool = True):
        self.data, self.at = data, 8
        if data[:4] != b"\xca\xfe\xba\xbe":
            raise ValueError("not a class file")
        self.pool: list[tuple[int, object]] = [(0, None)]
        n = self._u2()
        while len(self.pool) < n:
            tag = data[self.at]
            self.at += 1
            if tag == 1:
                size = self._u2()
                self.pool.append((1, data[self.at : self.at + size].decode("utf-8", "replace")))
                self.at += size
            else:
                self.pool.append((tag, data[self.at : self.at + POOL_SIZE[tag]]))
                self.at += POOL_SIZE[tag]
                if tag in (5, 6):
                    self.pool.append((0, None))
        self.access = self._u2()
        self.name = self._class(self._u2())
        parent = self._u2()
        self.supertypes = ([self._class(parent)] if parent else []) + [self._class(self._u2()) for _ in range(self._u2())]
        self.members: list[tuple[str, str, str]] = []
        # method and descriptor (null: the class header), owner, name and descriptor (null: the class itself), kind
        self.refs: list[tuple[str | None, str | None, str, str | None, str | None, str]] = [(None, None, s, None, None, "class") for s in self.supertypes if s != self.name]
        self.dynamic: list[tuple[str, str, int]] = []
        self.bodies: dict[tuple[str, str], str] = {}
        self.bootstraps: list[tuple[int, list[int]]] = []
        written: dict[tuple[str, str], list] = {}
        for kind in ("field", "method"):
            for _ in range(self._u2()):
                self.at += 2
                name, desc = self._utf(self._u2()), self._utf(self._u2())
                self.members.append((kind, name, desc))
                for _ in range(self._u2()):
                    attr, size = self._utf(self._u2()), struct.unpack_from(">I", data, self.at)[0]
                    self.at += 4
                    if attr == "Code" and with_code:
                        code = struct.unpack_from(">I", data, self.at + 4)[0]
                        at = self.at + 8 + code
                        tries = [struct.unpack_from(">HHHH", data, at + 2 + 8 * i) for i in range(struct.unpack_from(">H", data, at)[0])]
                        written[name, desc] = self._code(name, desc, data[self.at + 8 : at], tries)
                    self.at += size
        if self.dynamic:
            self._handles()
        for key, lines in written.items():  # what lambdas are made of is known only now
            self.bodies[key] = "\n".join(x if isinstance(x, str) else f"{x[0]} {self._bootstrap(x[1])}".rstrip() for x in lines)

    def _handles(self) -> None:
        """Method references hide in the bootstrap arguments of lambdas; other bootstraps are no calls."""
        for _ in range(self._u2()):
            attr, size = self._utf(self._u2()), struct.unpack_from(">I", self.data, self.at)[0]
            self.at += 4
            if attr != "BootstrapMethods":
                self.at += size
                continue
            for _ in range(self._u2()):
                factory = self._u2()
                self.bootstraps.append((factory, [self._u2() for _ in range(self._u2())]))
            for name, desc, i in self.dynamic:
                factory, args = self.bootstraps[i]
                if self._handle(factory)[0] == LAMBDAS:
                    for a in args:
                        if self.pool[a][0] == 15:
                            self._refer(name, desc, *self._handle(a), "call")

    def _handle(self, i: int) -> tuple[str, str, str]:
        return self._member(struct.unpack(">BH", self.pool[i][1])[1])

    def _refer(self, name: str, desc: str, owner: str, member: str, descriptor: str, kind: str) -> None:
        """A member refers to its own class's members too; the class as a whole only to others."""
        self.refs.append((name, desc, owner, member, descriptor, kind))
        if owner != self.name:
            self.refs.append((name, desc, owner, None, None, kind))

    def _constant(self, i: int) -> str:
        tag, value = self.pool[i]
        if tag == 7:
            return _type(self._class(i))
        if tag == 8:
            return re.sub("[{}]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(self._class(i)))
        if tag == 15:
            return " ".join((_type((h := self._handle(i))[0]), h[1], _types(h[2])))
        if tag == 16:
            return _types(self._class(i))
        if tag == 17:
            return " ".join(map(_types, map(self._utf, struct.unpack(">HH", self.pool[struct.unpack(">HH", value)[1]][1]))))
        return f"{tag}:{value.hex()}"

    def _bootstrap(self, i: int) -> str:
        """What makes a dynamic call's target: its factory and the constants that it is given."""
        if i >= len(self.bootstraps):
            return ""
        factory, args = self.bootstraps[i]
        return " ".join([self._constant(factory), *map(self._constant, args)])

    def fold(self, name: str | None, desc: str | None) -> tuple[str | None, str | None, str | None]:
        """(method, descriptor, synthetic name): a lambda's body belongs to the method that it is written in.

        The descriptor is null where that method is overloaded; a lambda whose method
        the class doesn't declare stays as it is.
        """
        if name is None or not name.startswith("lambda$"):
            return name, desc, None
        inner = name[7:].rpartition("$")[0] or name[7:]
        inner = {"new": "<init>", "static": "<clinit>"}.get(inner, inner)
        descs = [d for kind, n, d in self.members if kind == "method" and n == inner]
        return (inner, descs[0] if len(descs) == 1 else None, name) if descs else (name, desc, None)

    def _u2(self) -> int:
        self.at += 2
        return struct.unpack_from(">H", self.data, self.at - 2)[0]

    def _utf(self, i: int) -> str:
        return self.pool[i][1]

    def _class(self, i: int) -> str:
        return self._utf(struct.unpack(">H", self.pool[i][1])[0])

    def _member(self, i: int) -> tuple[str, str, str]:
        c, nt = struct.unpack(">HH", self.pool[i][1])
        n, d = struct.unpack(">HH", self.pool[nt][1])
        return self._class(c), self._utf(n), self._utf(d)

    def _code(self, name: str, desc: str, code: bytes, tries: list[tuple[int, int, int, int]]) -> list:
        """Lines of a body that don't depend on where things lie: constants by value, and jump targets as labels that
        are numbered in the order in which they are met. A dynamic call is a pair of its line and its bootstrap."""
        steps = list(_instructions(code))
        targets = {t for _, _, _, ts in steps for t in ts} | {t for row in tries for t in row[:3]}
        labels: dict[int, int] = {}
        label = lambda at: f"L{labels.setdefault(at, len(labels))}"
        lines: list = [f"try {label(a)} {label(b)} {label(h)} {_type(self._class(t)) if t else '*'}" for a, b, h, t in tries]
        for start, op, raw, jumps in steps:
            if start in targets:
                lines.append(label(start))
            operand = " ".join([*([raw] if isinstance(raw, str) and raw else []), *map(label, jumps)])
            if op in KINDS:
                k = struct.unpack_from(">H", code, start + 1)[0]
                if op >= 187:
                    owner = self._class(k)
                    operand = _type(owner)
                    if owner != self.name:
                        self.refs.append((name, desc, owner, None, None, KINDS[op]))
                else:
                    owner, member, descriptor = self._member(k)
                    operand = f"{_type(owner)} {member} {_types(descriptor)}"
                    self._refer(name, desc, owner, member, descriptor, KINDS[op])
            elif op == 186:
                i, nt = struct.unpack(">HH", self.pool[struct.unpack_from(">H", code, start + 1)[0]][1])
                member, descriptor = map(self._utf, struct.unpack(">HH", self.pool[nt][1]))
                self.dynamic.append((name, desc, i))
                lines.append((f"{op} {member} {_types(descriptor)}", i))
                continue
            elif op in (18, 19, 20):  # constants by value: their places in the pool differ between builds
                op, operand = 18, self._constant(code[start + 1] if op == 18 else struct.unpack_from(">H", code, start + 1)[0])
            elif op == 197:
                operand = f"{_type(self._class(struct.unpack_from('>H', code, start + 1)[0]))} {code[start + 3]}"
            lines.append(f"{op} {operand}".rstrip())
        return lines + ([label(len(code))] if len(code) in targets else [])


def _type(name: str) -> str:
    """A class in a body, in braces, so that it can be renamed without parsing the line."""
    return _types(name) if name.startswith("[") else f"{{{name}}}"


def _types(descriptor: str) -> str:
    return re.sub("L([^;]+);", r"{\1}", descriptor)


def _instructions(code: bytes) -> Iterator[tuple[int, int, str, list[int]]]:
    """(offset, opcode, operand, jump targets); wide and short spellings of an instruction are the same one."""
    i = 0
    while i < len(code):
        op, start = code[i], i
        i += 1
        if op in (170, 171):
            i += (-i) % 4
            default, = struct.unpack_from(">i", code, i)
            if op == 170:
                low, high = struct.unpack_from(">ii", code, i + 4)
                n = high - low + 1
                cases, told = struct.unpack_from(f">{n}i", code, i + 12), f"{low} {high}"
                i += 12 + 4 * n
            else:
                n, = struct.unpack_from(">i", code, i + 4)
                pairs = struct.unpack_from(f">{2 * n}i", code, i + 8)
                cases, told = pairs[1::2], " ".join(map(str, pairs[::2]))
                i += 8 + 8 * n
            yield start, op, told, [start + c for c in (*cases, default)]
        elif op == 196:
            op = code[i]
            local = struct.unpack_from(">H", code, i + 1)[0]
            yield start, op, f"{local} {struct.unpack_from('>h', code, i + 3)[0]}" if op == 132 else str(local), []
            i += 5 if op == 132 else 3
        elif op in JUMPS or op in FAR_JUMPS:
            far = op in FAR_JUMPS
            to = struct.unpack_from(">i" if far else ">h", code, i)[0]
            yield start, op - 33 if far else op, "", [start + to]
            i += 4 if far else 2
        else:
            size = 1 if op in ONE_BYTE else 2 if op in TWO_BYTES else 4 if op in FOUR_BYTES else 3 if op == 197 else 0
            raw = code[i : i + size]
            i += size
            if op == 132:
                yield start, op, f"{raw[0]} {struct.unpack('>b', raw[1:])[0]}", []
            elif op in (*range(21, 26), *range(54, 59), 169):
                yield start, op, str(raw[0]), []
            elif 26 <= op <= 45 or 59 <= op <= 78:
                first, base = (26, 21) if op <= 45 else (59, 54)
                yield start, base + (op - first) // 4, str((op - first) % 4), []
            else:
                yield start, op, raw.hex(), []


def simple_class(name: str, parent: str, fields: list[tuple[str, str]] = (), methods: list[tuple[str, str]] = (), calls: list[tuple[str, str, str]] = (), access: int = 0x421, handles: list[tuple[str, str, str]] = (), factory: str = LAMBDAS, before: list[str] = (), code=None, tries: list[tuple[int, int, int, str]] = ()) -> bytes:
    """A class file; each method calls all of ``calls`` (owner, name, descriptor) in order, makes lambdas of ``handles`` and returns.

    before: texts that come first in the constant pool; code: a method's bytes, from a function that
    gives the place of a text's constant; tries: (start, end, handler, class) of each method.
    """
    pool: list[bytes] = []
    known: dict[bytes, int] = {}

    def add(b: bytes) -> int:
        if b not in known:
            pool.append(b)
            known[b] = len(pool)
        return known[b]

    for text in before:
        add(b"\x01" + struct.pack(">H", len(text.encode())) + text.encode())
    utf = lambda s: add(b"\x01" + struct.pack(">H", len(s.encode())) + s.encode())
    cls = lambda s: add(b"\x07" + struct.pack(">H", utf(s)))
    ref = lambda o, n, d: add(b"\x0a" + struct.pack(">HH", cls(o), add(b"\x0c" + struct.pack(">HH", utf(n), utf(d)))))
    body = b"".join(b"\xb8" + struct.pack(">H", ref(*c)) for c in calls)
    handle = lambda o, n, d: add(b"\x0f" + struct.pack(">BH", 6, ref(o, n, d)))
    made = add(b"\x0c" + struct.pack(">HH", utf("run"), utf("()Ljava/lang/Runnable;"))) if handles else 0
    body += b"".join(b"\xba" + struct.pack(">HH", add(b"\x12" + struct.pack(">HH", i, made)), 0) for i in range(len(handles))) + b"\xb1"
    body = code(lambda text: add(b"\x08" + struct.pack(">H", utf(text)))) if code else body
    caught = struct.pack(">H", len(tries)) + b"".join(struct.pack(">HHHH", a, b, h, cls(t)) for a, b, h, t in tries)
    boot = struct.pack(">H", len(handles)) + b"".join(struct.pack(">HHH", handle(factory, "metafactory", "()V"), 1, handle(*h)) for h in handles)
    last = struct.pack(">HHI", 1, utf("BootstrapMethods"), len(boot)) + boot if handles else struct.pack(">H", 0)
    attr = struct.pack(">HI", utf("Code"), 10 + len(body) + len(caught)) + struct.pack(">HHI", 1, 1, len(body)) + body + caught + struct.pack(">H", 0)
    this, base = cls(name), cls(parent)
    fs = b"".join(struct.pack(">HHHH", 1, utf(n), utf(d), 0) for n, d in fields)
    ms = b"".join(struct.pack(">HHHH", 1, utf(n), utf(d), 1) + attr for n, d in methods)
    head = b"\xca\xfe\xba\xbe" + struct.pack(">HH", 0, 61)
    return head + struct.pack(">H", len(pool) + 1) + b"".join(pool) + struct.pack(">HHHH", access, this, base, 0) + struct.pack(">H", len(fields)) + fs + struct.pack(">H", len(methods)) + ms + last


def classes_in(content: bytes) -> Iterator[bytes]:
    """Class files of a jar, or the file itself."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n in z.namelist():
                if n.endswith(".class") and not n.endswith(("module-info.class", "package-info.class")):
                    yield z.read(n)
    else:
        yield content


DECLARATIONS = "owner string, access int, supertypes array<string>, members array<struct<kind: string, name: string, descriptor: string>>"
REFERENCES = "ref_owner string, ref_member string, ref_descriptor string, owner string, member string, descriptor string, kind string, ref_synthetic string"


def read_declarations(files: DataFrame, content: str = "content") -> DataFrame:
    """Owner, access flags, supertypes (superclass first) and members of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("descriptor", pa.string())]))
        for b in batches:
            cs = [ClassFile(c, False) for x in b.column(0).to_pylist() if x for c in classes_in(x)]
            yield pa.RecordBatch.from_arrays([pa.array([c.name for c in cs], pa.string()), pa.array([c.access for c in cs], pa.int32()), pa.array([c.supertypes for c in cs], pa.list_(pa.string())), pa.array([[dict(zip(("kind", "name", "descriptor"), m)) for m in c.members] for c in cs], member)], ["owner", "access", "supertypes", "members"])

    return files.select(content).mapInArrow(run, DECLARATIONS)


def read_references(files: DataFrame, content: str = "content") -> DataFrame:
    """One row for each reference of an instruction or a class header; unknown owners are dropped.

    A lambda's body counts as its method, its own name is ``ref_synthetic``. ``member`` is
    null where a class as a whole is referred to, ``ref_member`` in a header.
    """
    names = [f.split()[0] for f in REFERENCES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                for c in map(ClassFile, classes_in(x) if x else ()):
                    rows = []
                    for m, d, *target in c.refs:
                        method, descriptor, synthetic = c.fold(m, d)
                        rows.append((c.name, method, descriptor, *target, synthetic))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)

    known = read_declarations(files, content).select("owner").distinct()
    return files.select(content).mapInArrow(run, REFERENCES).join(known, "owner", "left_semi")


def read_instructions(files: DataFrame, content: str = "content") -> DataFrame:
    """(owner, member, descriptor, target) of each instruction that refers to a member or names a class, methods as they are named."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                for c in map(ClassFile, classes_in(x) if x else ()):
                    rows = [(c.name, m, d, ":".join([owner, *([n, desc] if n else [])])) for m, d, owner, n, desc, kind in c.refs if m is not None and (n or kind in ("new", "type"))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["owner", "member", "descriptor", "target"])

    return files.select(content).mapInArrow(run, "owner string, member string, descriptor string, target string")


def read_bodies(files: DataFrame, content: str = "content") -> DataFrame:
    """(owner, member, descriptor, body): the instructions of each method with the names that they use."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                for c in map(ClassFile, classes_in(x) if x else ()):
                    rows = [(c.name, *k, text) for k, text in c.bodies.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["owner", "member", "descriptor", "body"])

    return files.select(content).mapInArrow(run, "owner string, member string, descriptor string, body string")


def subtypes(decls: DataFrame) -> DataFrame:
    """Inverted supertype edges among the declared classes."""
    e = decls.select(F.explode("supertypes").alias("parent"), F.col("owner").alias("child"))
    return e.join(decls.select(F.col("owner").alias("parent")), "parent", "left_semi").groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("subtypes"))
