"""Stack programs over whole columns: words that pop and push columns, compiled to DataFrame plans.

``u64[1 5 3 9] dup 4u64 >= where gather`` leaves the values from 4 on. A column is an expression over a
numbered frame; words that work element by element only build the expression, so columns that come from
one frame share it and a whole chain is one projection. Columns of different frames meet by an equi-join
on the position. Filters keep the frame's other columns with them; running sums, sorts and searches use
the two-level operators of ``operators.seq``. Nothing is collected.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalar
from tessera.functions.keys import structural_key
from tessera.operators import seq
from tessera.sources.readers import column as literal_column

TOKEN = re.compile(r"#[^\n]*|[\s,]+|(\.\{|->|:\[|[\[\]{};]|[^\s\[\]{};,#]+)")
SCALAR = re.compile(r"(-?\d+(?:\.\d+)?)(u8|u16|u32|u64|i8|i16|i32|i64|f32|f64)?$")
TRUTH = {"t": True, "true": True, "1": True, "f": False, "false": False, "0": False}


class StackError(ValueError):
    pass


#: Words whose number of columns may follow without a dot.
ARITY = re.compile(r"(entuple|detuple|cat|partition|inject|branch|merge)(\d+)$")


class Frame:
    """Numbered rows: ``pos`` from 0, and any other columns."""

    def __init__(self, df: DataFrame, single: bool = False):
        self.df, self.single = df, single
        self.filtered: dict[str, Frame] = {}


class Col:
    """An expression over a frame; ``const`` is set on literals of length one."""

    def __init__(self, frame: Frame, expr: Column, const: Column | None = None, mask: tuple | None = None):
        self.frame, self.expr, self.const, self.mask = frame, expr, const, mask
        self.viewed: tuple[Col, Col] | None = None  # a view's source and positions

    def rows(self, name: str = "v") -> DataFrame:
        return self.frame.df.select("pos", self.expr.alias(name))

    @property
    def type(self) -> T.DataType:
        return self.frame.df.select(self.expr.alias("v")).schema["v"].dataType

    @property
    def listed(self) -> bool:
        return isinstance(self.type, T.ArrayType)


def fresh(df: DataFrame, *names: str, single: bool = False) -> list[Col]:
    frame = Frame(df, single)
    return [Col(frame, F.col(n)) for n in names]


def together(*cols: Col) -> tuple[Frame, list[Column]]:
    """One frame under all columns. Frames of different lengths fail when they run; one row is broadcast."""
    lead = next((c for c in cols if c.const is None and not c.frame.single), None) or next((c for c in cols if c.const is None), cols[0])
    frame, out, joined = lead.frame, [], None
    for c in cols:
        if c.frame is lead.frame:
            out.append(c.expr)
        elif c.const is not None:
            out.append(c.const)
        else:
            joined = joined if joined is not None else lead.frame.df
            name = f"j{len(out)}_{len(joined.columns)}"
            if c.frame.single:
                joined = joined.join(F.broadcast(c.frame.df.select(c.expr.alias(name))))
            else:
                other = c.rows(name).withColumn(f"{name}_in", F.lit(True))
                joined = joined.withColumn("__left", F.lit(True)).join(other, "pos", "full")
                fine = F.assert_true(F.col("__left").isNotNull() & F.col(f"{name}_in").isNotNull(), F.lit("columns differ in length"))
                joined = joined.where(fine.isNull()).drop("__left", f"{name}_in")
            out.append(F.col(name))
    return (frame if joined is None else Frame(joined)), out


class Machine:
    def __init__(self, spark: SparkSession):
        self.spark, self.stack, self.macros, self.clock = spark, [], {}, time.perf_counter()
        self.profile: dict[str, list[float]] | None = None

    # ------------------------------------------------------------ reading

    def run(self, source: str, table: DataFrame | None = None) -> list[DataFrame]:
        tokens = [m[1] for m in TOKEN.finditer(source) if m[1]]
        columns = [] if table is None else [c for c in table.columns if c != "pos"]
        self.block(tokens, dict(zip(columns, fresh(table, *columns), strict=True)) if columns else {})
        return [c.rows() for c in self.stack]

    @staticmethod
    def closing(tokens: list[str], at: int) -> int:
        depth = 0
        for k in range(at, len(tokens)):
            depth += (tokens[k] in ("{", ".{")) - (tokens[k] == "}")
            if depth == 0:
                return k
        raise StackError("} is missing")

    @staticmethod
    def parts(tokens: list[str], mark: str) -> list[list[str]]:
        out, depth = [[]], 0
        for t in tokens:
            depth += (t in ("{", ".{")) - (t == "}")
            if t == mark and depth == 0:
                out.append([])
            else:
                out[-1].append(t)
        return out

    def block(self, tokens: list[str], names: dict[str, Col]) -> None:
        names, at = dict(names), 0
        while at < len(tokens):
            t = tokens[at]
            after = tokens[at + 1] if at + 1 < len(tokens) else ""
            if t in scalar.TYPES and after == "[":
                end = tokens.index("]", at)
                self.literal(t, tokens[at + 2 : end])
                at = end
            elif t == "def":
                end = self.closing(tokens, at + 2)
                self.macros[after] = tokens[at + 3 : end]
                at = end
            elif t == "{":
                end = self.closing(tokens, at)
                self.block(tokens[at + 1 : end], names)
                at = end
            elif t == ".{":
                end = self.closing(tokens, at)
                self.cleave(self.parts(tokens[at + 1 : end], ";"), names)
                at = end
            elif t == "match" and after == "{":
                end = self.closing(tokens, at + 1)
                self.match(self.parts(tokens[at + 2 : end], "->")[1:], names)
                at = end
            elif t == ":[":
                end = tokens.index("]", at)
                for n in reversed(tokens[at + 1 : end]):
                    names[n] = self.pop()
                at = end
            elif t.startswith(":") and len(t) > 1:
                names[t[1:]] = self.pop()
            elif t in names:
                self.push(names[t])
            elif t in self.macros:
                self.block(self.macros[t], names)
            elif t in ("pick", "roll"):
                n = int(after)
                self.push(self.stack[-1 - n] if t == "pick" else self.stack.pop(-1 - n))
                at += 1
            elif m := SCALAR.match(t):
                tag = m[2] or ("f64" if "." in m[1] else "i64")
                value = F.lit(float(m[1]) if tag[0] == "f" else int(m[1])).cast(scalar.TYPES[tag])
                self.push(Col(Frame(self.spark.range(1).withColumnRenamed("id", "pos"), True), value, const=value))
            else:
                began, profile = time.perf_counter(), self.profile
                self.word(t)
                if profile is not None:
                    profile.setdefault(t, []).append(time.perf_counter() - began)
            at += 1

    def pop(self) -> Col:
        if not self.stack:
            raise StackError("the stack is empty")
        return self.stack.pop()

    def push(self, *cols: Col) -> None:
        self.stack.extend(cols)

    def literal(self, tag: str, words: list[str]) -> None:
        read = TRUTH.__getitem__ if tag == "bool" else float if tag[0] == "f" else int
        df = literal_column(self.spark, tag, [read(w) for w in words], "v")
        self.push(*fresh(df.coalesce(1), "v"))

    # ------------------------------------------------------------ words

    def word(self, t: str) -> None:
        base, _, arg = t.partition(".")
        if t.startswith(".") and t[1:].isdigit():
            return self.field(int(t[1:]))
        if t in WORDS:
            return WORDS[t](self)
        if base in ARITH and arg in scalar.TYPES:
            return self.elementwise(2, ARITH[base](arg), arg)
        if base in COMPARE and (not arg or arg in scalar.TYPES):
            return self.elementwise(2, COMPARE[base], None)
        if base in ("neg", "abs") and arg in scalar.TYPES:
            if arg[0] == "u":
                raise StackError(f"{base} of an unsigned column")
            return self.elementwise(1, (lambda x: -x) if base == "neg" else F.abs, arg)
        if base == "as" and arg in scalar.TYPES:
            return self.elementwise(1, lambda x: x.cast(scalar.TYPES[arg]), None)
        if base in ("enswizzle", "deswizzle") and arg in scalar.TYPES:
            f = scalar.order_word if base == "enswizzle" else scalar.from_order_word
            return self.elementwise(1, lambda x: f(x, arg), None)
        if base == "square" and arg in scalar.TYPES:
            return self.elementwise(1, scalar.square, arg)
        if base == "clamp" and arg in scalar.TYPES:
            return self.clamp(arg)
        if base == "show":
            return self.show()
        if base == "reduce" and arg.split(".")[0] in ("+", "*", "min", "max"):
            return self.reduce(arg.split(".")[0])
        if base == "cumsum":
            return self.cumsum()
        if base == "shift":
            return self.shift()
        if not arg and (m := ARITY.match(base)):
            base, arg = m.groups()
        if base in ("entuple", "cat", "partition", "inject", "branch", "merge") and (arg.isdigit() or base == "branch"):
            return getattr(self, base)(int(arg or 2))
        if base == "detuple" and arg.isdigit():
            return self.detuple(int(arg))
        raise StackError(f"unknown word {t!r}")

    def elementwise(self, n: int, f, tag: str | None) -> None:
        cols = [self.pop() for _ in range(n)][::-1]
        frame, x = together(*cols)
        listed = [c.listed for c in cols]

        def value(*v: Column) -> Column:
            out = f(*v)
            return out.cast(scalar.TYPES[tag]) if tag else out

        if n == 1:
            out = F.transform(x[0], value) if listed[0] else value(x[0])
        elif all(listed):
            whole = F.assert_true(F.size(x[0]) == F.size(x[1]), F.lit("lists differ in length")).isNull()
            out = F.when(whole, F.zip_with(x[0], x[1], value))
        elif any(listed):
            out = F.transform(x[0], lambda v: value(v, x[1])) if listed[0] else F.transform(x[1], lambda v: value(x[0], v))
        else:
            out = value(*x)
        const = out if all(c.const is not None for c in cols) else None
        self.push(Col(frame, out, const=const))

    def field(self, i: int) -> None:
        c = self.pop()
        name = f"_{i}"
        self.push(Col(c.frame, F.transform(c.expr, lambda x: x[name]) if c.listed else c.expr[name]))

    def entuple(self, n: int) -> None:
        cols = [self.pop() for _ in range(n)][::-1]
        frame, x = together(*cols)
        self.push(Col(frame, F.struct(*(e.alias(f"_{i}") for i, e in enumerate(x)))))

    def detuple(self, n: int) -> None:
        c = self.pop()
        for i in range(n):
            self.push(c)
            self.field(i)

    def cleave(self, paths: list[list[str]], names: dict[str, Col]) -> None:
        c = self.pop()
        for p in paths:
            self.push(c)
            self.block(p, names)
        self.entuple(len(paths))

    def branch(self, n: int) -> None:
        """Sum from values and tags, checked against the number of lanes."""
        tag, x = self.pop(), self.pop()
        frame, (v, d) = together(x, tag)
        d = d.cast("int")
        fine = F.assert_true((d >= 0) & (d < n), F.lit("tag out of range")).isNull()
        self.push(Col(frame, F.when(fine, F.struct(d.cast("tinyint").alias("tag"), *(F.when(d == k, v).alias(f"l{k}") for k in range(n))))))

    def lanes(self, c: Col, n: int) -> list[Col]:
        """Each lane as a column of its own; the source position goes along."""
        out = []
        for k in range(n):
            rows = c.frame.df.select(F.col("pos").alias("src"), c.expr.alias("s")).where(F.col("s")["tag"] == k)
            out.append(fresh(seq.with_position(rows.select("src", F.col("s")[f"l{k}"].alias("v")), F.col("src")), "v")[0])
        return out

    def width(self, c: Col) -> int:
        return len(c.type.fields) - 1

    def split(self) -> None:
        c = self.pop()
        self.push(Col(c.frame, c.expr["tag"]), *self.lanes(c, self.width(c)))

    def partition(self, n: int) -> None:
        self.branch(n)
        self.push(*self.lanes(self.pop(), n))

    def inject(self, n: int) -> None:
        """Sum from tags and lanes: the kth row of a tag takes that lane's kth value."""
        lanes = [self.pop() for _ in range(n)][::-1]
        tags = self.pop()
        base = tags.rows("tag")
        out = None
        for k, lane in enumerate(lanes):
            mine = seq.with_position(base.where(F.col("tag") == k).withColumnRenamed("pos", "src"), F.col("src"))
            fine = F.assert_true(F.col("src").isNotNull() & F.col("__in").isNotNull(), F.lit("lane length differs")).isNull()
            got = mine.join(lane.rows().withColumn("__in", F.lit(True)), "pos", "full").where(fine).select(F.col("src").alias("pos"), F.lit(k).cast("tinyint").alias("tag"), F.col("v").alias(f"l{k}"))
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        frame = Frame(out)
        self.push(Col(frame, F.struct("tag", *(F.col(f"l{k}") for k in range(n)))))

    def merge(self, n: int) -> None:
        """Lanes of one type back in the order of their tags."""
        self.inject(n)
        c = self.pop()
        self.push(Col(c.frame, F.coalesce(*(c.expr[f"l{k}"] for k in range(n)))))

    def clamp(self, tag: str) -> None:
        if tag[0] == "f":
            raise StackError("clamp of a float column")
        high, low, x = self.pop(), self.pop(), self.pop()
        frame, (v, a, b) = together(x, low, high)
        self.push(Col(frame, scalar.clamp(v, a, b).cast(scalar.TYPES[tag])))

    def match(self, arms: list[list[str]], names: dict[str, Col]) -> None:
        """Each arm on its lane; the results go back to their source positions."""
        c, out = self.pop(), None
        for lane, arm in zip(self.lanes(c, len(arms)), arms, strict=True):
            depth = len(self.stack)
            self.push(lane)
            self.block(arm, names)
            r = self.pop()
            if len(self.stack) != depth:
                raise StackError("an arm must leave one column")
            back = r.rows().join(lane.frame.df.select("pos", "src"), "pos").select(F.col("src").alias("pos"), "v")
            out = back if out is None else out.union(back)
        self.push(*fresh(out, "v"))

    def where(self) -> None:
        m = self.pop()
        if m.listed:
            return self.push(Col(m.frame, F.filter(F.transform(m.expr, lambda v, i: F.when(v, i.cast("bigint"))), lambda v: v.isNotNull())))
        key = str(m.expr)
        if key not in m.frame.filtered:
            kept = m.frame.df.where(m.expr.cast("boolean")).withColumnRenamed("pos", "src").drop("__at")
            m.frame.filtered[key] = Frame(seq.with_position(kept, F.col("src")))
        small = m.frame.filtered[key]
        self.push(Col(small, F.col("src"), mask=(m.frame, small)))

    def gather(self) -> None:
        """Values at positions; positions of a mask over the values' own frame are a filter."""
        at, x = self.pop(), self.pop()
        self.gathered(at, x)
        self.stack[-1].viewed = x, at

    def decompose_view(self) -> None:
        """The source and the positions that a view was made of."""
        c = self.pop()
        if c.viewed is None:
            raise StackError("not a view")
        self.push(*c.viewed)

    def gathered(self, at: Col, x: Col) -> None:
        if at.mask and at.mask[0] is x.frame:
            return self.push(Col(at.mask[1], x.expr))
        rows = at.frame.df.withColumn("__at", at.expr).join(x.rows("__got").withColumnRenamed("pos", "__at").withColumn("__in", F.lit(True)), "__at", "left")
        fine = F.assert_true(F.col("__in").isNotNull(), F.lit("position out of range")).isNull()
        self.push(*fresh(rows.where(fine).select("pos", F.col("__got").alias("v")), "v"))

    def filter(self) -> None:
        m, x = self.pop(), self.pop()
        if m.listed:
            frame, (v, k) = together(x, m)
            same = F.assert_true(F.size(v) == F.size(k), F.lit("lists differ in length")).isNull()
            pairs = F.zip_with(v, k, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return self.push(Col(frame, F.when(same, F.transform(F.filter(pairs, lambda p: p["b"]), lambda p: p["a"]))))
        frame, (v, k) = together(x, m)
        self.push(Col(frame, v), Col(frame, k))
        self.where()
        self.gather()

    def key(self, c: Col) -> Column:
        """Structural order; the unsigned reading of a word is the reading of its type here."""
        return structural_key(c.expr, c.type)

    def sort(self, perm: bool = False) -> None:
        c = self.pop()
        rows = c.frame.df.select(F.col("pos").alias("src"), c.expr.alias("v"), self.key(c).alias("k"))
        self.push(*fresh(seq.with_position(rows, F.col("k"), F.col("src")), "src" if perm else "v"))

    def sort_segments(self) -> None:
        c = self.pop()
        inner = c.type.elementType
        keyed = F.transform(c.expr, lambda v, i: F.struct(structural_key(v, inner).alias("k"), i.alias("i"), v.alias("v")))
        self.push(Col(c.frame, F.transform(F.array_sort(keyed), lambda s: s["v"])))

    def group(self) -> None:
        keys, vals = self.pop(), self.pop()
        frame, (v, k) = together(vals, keys)
        lists = frame.df.select("pos", v.alias("v"), k.alias("k")).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("l"))
        kind = lists.schema["k"].dataType
        self.push(*fresh(seq.with_position(lists, structural_key(F.col("k"), kind)), "k", "l"))

    def unique(self) -> None:
        c = self.pop()
        rows = c.rows().select("v").distinct()
        self.push(*fresh(seq.with_position(rows, structural_key(F.col("v"), rows.schema["v"].dataType)), "v"))

    def reduce(self, how: str) -> None:
        c = self.pop()
        zero = {"+": 0, "*": 1}
        step = {"+": lambda a, x: a + x, "*": lambda a, x: a * x}
        if c.listed:
            kind = c.type.elementType.simpleString()
            wide = "double" if kind in ("float", "double") else "bigint"
            if how in zero:
                out = F.aggregate(F.transform(c.expr, lambda x: x.cast(wide)), F.lit(zero[how]).cast(wide), step[how])
            else:
                some = F.assert_true(F.size(c.expr) > 0, F.lit("minimum or maximum of an empty row")).isNull()
                out = F.when(some, (F.array_min if how == "min" else F.array_max)(c.expr))
            return self.push(Col(c.frame, out))
        agg = {"+": lambda v: F.coalesce(F.sum(v), F.lit(0)), "*": lambda v: F.coalesce(F.product(v), F.lit(1)).cast("bigint"), "min": F.min, "max": F.max}[how]
        self.push(*fresh(c.frame.df.agg(agg(c.expr).alias("v")).select(F.lit(0).cast("bigint").alias("pos"), "v"), "v", single=True))

    def every(self, how: str) -> None:
        c = self.pop()
        if c.listed:
            return self.push(Col(c.frame, (F.exists if how == "any" else F.forall)(c.expr, lambda v: v)))
        agg = F.coalesce((F.bool_or if how == "any" else F.bool_and)(c.expr), F.lit(how == "all"))
        self.push(*fresh(c.frame.df.agg(agg.alias("v")).select(F.lit(0).cast("bigint").alias("pos"), "v"), "v", single=True))

    def cumsum(self) -> None:
        c = self.pop()
        if c.listed:
            kind = c.type.elementType.simpleString()
            start = F.struct(F.lit(0).cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("o"))
            go = lambda a, x: F.struct((a["s"] + x).cast(kind).alias("s"), F.concat(a["o"], F.array((a["s"] + x).cast(kind))).alias("o"))
            return self.push(Col(c.frame, F.aggregate(c.expr, start, go, lambda a: a["o"])))
        self.push(*fresh(seq.running(c.rows(), F.col("v"), F.col("pos")).select("pos", F.col("running").alias("v")), "v"))

    def constant(self, c: Col) -> int:
        """The number of a literal: words that take a count read it from the text."""
        if c.const is None:
            raise StackError("a literal count is needed here")
        return int(self.spark.range(1).select(c.const.alias("v")).first()["v"])

    def shift(self) -> None:
        n, c = self.constant(self.pop()), self.pop()
        if c.listed:
            zero = F.lit(0).cast(c.type.elementType)
            return self.push(Col(c.frame, F.transform(c.expr, lambda _, i: F.when(i < n, zero).otherwise(F.get(c.expr, i - n)))))
        earlier = c.frame.df.select((F.col("pos") + n).alias("pos"), c.expr.alias("__s"))
        moved = c.frame.df.join(earlier, "pos", "left").select("pos", F.coalesce("__s", F.lit(0)).alias("v"))
        self.push(*fresh(moved, "v"))

    def iota(self) -> None:
        self.push(*fresh(self.spark.range(self.constant(self.pop())).select(F.col("id").alias("pos"), F.col("id").alias("v")), "v"))

    def like(self) -> None:
        one, shape = self.pop(), self.pop()
        frame, (v, _) = together(one, shape)
        self.push(Col(frame, v))

    def spread(self) -> None:
        n, x = self.pop(), self.pop()
        frame, (v, k) = together(x, n)
        rows = seq.spread(frame.df.select(F.col("pos").alias("src"), v.alias("v"), k.alias("k")), F.col("k"))
        self.push(*fresh(seq.with_position(rows, F.col("src"), F.col("copy")), "v"))

    def cat(self, n: int) -> None:
        cols = [self.pop() for _ in range(n)][::-1]
        self.push(*fresh(seq.cat(*(c.rows() for c in cols)), "v"))

    def nest(self) -> None:
        bounds, x = self.pop(), self.pop()
        ends = bounds.rows("hi")
        ranges = ends.select(F.col("pos").alias("row"), "hi").join(ends.select((F.col("pos") + 1).alias("row"), F.col("hi").alias("lo")), "row").select((F.col("row") - 1).alias("row"), "lo", "hi")
        lists = seq.nest(x.rows("value"), ranges)
        self.push(*fresh(lists.select(F.col("row").alias("pos"), F.col("list").alias("v")), "v"))

    def nest_stride(self) -> None:
        k, x = self.constant(self.pop()), self.pop()
        self.push(*fresh(seq.nest_stride(x.rows("value"), k).select(F.col("row").alias("pos"), F.col("list").alias("v")), "v"))

    def bounds(self) -> None:
        c = self.pop()
        hi = seq.list_ranges(c.rows(), "pos", "v").select((F.col("pos") + 1).alias("pos"), F.col("hi").alias("v"))
        self.push(*fresh(hi.union(self.spark.range(1).selectExpr("0L pos", "0L v")), "v"))

    def ranges(self) -> None:
        c = self.pop()
        self.push(*fresh(seq.list_ranges(c.rows(), "pos", "v").select("pos", F.struct(F.col("lo").alias("_0"), F.col("hi").alias("_1")).alias("v")), "v"))

    def flatten(self, with_bounds: bool = True) -> None:
        c = self.pop()
        flat = seq.flatten(c.rows(), "pos", "v", pos="__p")
        self.push(*fresh(flat.select(F.col("__p").alias("pos"), F.col("value").alias("v")), "v"))
        if with_bounds:
            self.push(c)
            self.bounds()

    def keys(self) -> None:
        """Row number of every element of a list column."""
        c = self.pop()
        flat = seq.flatten(c.rows(), "pos", "v", pos="__p")
        self.push(*fresh(flat.select(F.col("__p").alias("at"), F.col("pos").alias("v")).withColumnRenamed("at", "pos"), "v"))

    def enlist(self) -> None:
        c = self.pop()
        one = seq.enlist(c.rows("value"), "value")
        self.push(*fresh(one.select(F.lit(0).cast("bigint").alias("pos"), F.col("list").alias("v")), "v", single=True))

    def unlist(self) -> None:
        c = self.pop()
        self.push(*fresh(seq.unlist(c.rows("list")).select("pos", F.col("value").alias("v")), "v"))

    def count(self) -> None:
        c = self.pop()
        self.push(Col(c.frame, F.size(c.expr).cast("bigint")))

    def head(self) -> None:
        c = self.pop()
        self.push(Col(c.frame, F.element_at(c.expr, 1)))

    def reverse(self) -> None:
        c = self.pop()
        self.push(*fresh(seq.reverse(c.rows()), "v"))

    def taken(self, skip: bool) -> None:
        n, c = self.constant(self.pop()), self.pop()
        self.push(*fresh((seq.skip if skip else seq.take)(c.rows(), n), "v"))

    def segments(self, f) -> None:
        c = self.pop()
        self.push(Col(c.frame, f(c.expr)))

    def take_segments(self) -> None:
        n = self.constant(self.pop())
        self.segments(lambda e: F.slice(e, 1, n))

    def view_range(self) -> None:
        hi, lo, c = self.constant(self.pop()), self.constant(self.pop()), self.pop()
        out = fresh(seq.view_range(c.rows(), lo, hi).withColumn("pos", F.col("pos") - lo), "v")[0]
        out.viewed = c, Col(out.frame, F.col("pos") + lo)
        self.push(out)

    def search(self) -> None:
        queries, target = self.pop(), self.pop()
        if queries.listed:
            frame, (t, q) = together(target, queries)
            return self.push(Col(frame, F.transform(q, lambda x: F.size(F.filter(t, lambda y: y < x)).cast("bigint"))))
        got = seq.lower_bound(queries.rows("k"), target.rows("k").select("k"), "k", "at")
        self.push(*fresh(got.select("pos", F.col("at").alias("v")), "v"))

    def intersect(self) -> None:
        """Positions of equal elements in either column; per row for lists (positions in the flat columns)."""
        b, a = self.pop(), self.pop()
        if a.listed:
            sides = []
            for c, n in ((a, "pa"), (b, "pb")):
                sides.append(seq.flatten(c.rows(), "pos", "v", pos=n).select(F.col("pos").alias("row"), F.col("value").alias("k"), n))
            both = sides[0].join(sides[1], ["row", "k"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "pa", "pb"))).alias("l"))
            rows = a.frame.df.select(F.col("pos").alias("row")).join(both, "row", "left").select(F.col("row").alias("pos"), F.coalesce("l", F.array().cast(both.schema["l"].dataType)).alias("l"))
            frame = Frame(rows)
            return self.push(Col(frame, F.transform("l", lambda x: x["pa"])), Col(frame, F.transform("l", lambda x: x["pb"])))
        pairs = a.rows("k").withColumnRenamed("pos", "pa").join(b.rows("k").withColumnRenamed("pos", "pb"), "k")
        self.push(*fresh(seq.with_position(pairs, F.col("k"), F.col("pa"), F.col("pb")), "pa", "pb"))

    def xprod(self) -> None:
        c = self.pop()
        pairs = F.flatten(F.transform(c.expr["_0"], lambda x: F.transform(c.expr["_1"], lambda y: F.struct(x.alias("_0"), y.alias("_1")))))
        self.push(Col(c.frame, pairs))

    def over(self, *order: int) -> None:
        """Rearrange: the top len(order) or so columns, deepest first, replaced by those named."""
        n = max(order) + 1
        held = [self.pop() for _ in range(n)][::-1]
        self.push(*(held[k] for k in order))

    def timed(self) -> None:
        """Print the time since the last call (or the beginning). Words build plans: what runs later isn't in it."""
        now = time.perf_counter()
        print(f"time: {1000 * (now - self.clock):.0f} ms")
        self.clock = now

    def profiled(self, on: bool) -> None:
        """Time per word (building its plan, and the jobs that it starts at once), longest first."""
        for word, took in sorted((self.profile or {}).items(), key=lambda x: -sum(x[1])) * (not on):
            print(f"{word}: {len(took)} x, {1000 * sum(took):.1f} ms")
        self.profile = {} if on else None

    def show(self, rows: int = 20) -> None:
        """Print the first rows of the top column, which stays."""
        c = self.pop()
        self.push(c)
        got = c.rows().orderBy("pos").limit(rows + 1).collect()
        print(f"{c.type.simpleString()}[{' '.join(str(r.v) for r in got[:rows])}{' ...' * (len(got) > rows)}]")


def _div(tag: str):
    return scalar.ieee_div if tag[0] == "f" else scalar.truncating_div


ARITH = {"+": lambda t: lambda a, b: a + b, "-": lambda t: lambda a, b: a - b, "*": lambda t: lambda a, b: a * b, "/": _div, "%": lambda t: lambda a, b: a % b, "mod": lambda t: lambda a, b: a % b}
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b), ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
WORDS = {
    "dup": lambda m: m.over(0, 0), "drop": lambda m: m.pop() and None, "swap": lambda m: m.over(1, 0), "over": lambda m: m.over(0, 1, 0), "rot": lambda m: m.over(1, 2, 0), "time": Machine.timed, "profile.start": lambda m: m.profiled(True), "profile.print": lambda m: m.profiled(False),
    "not": lambda m: m.elementwise(1, lambda a: ~a.cast("boolean"), None), "and": lambda m: m.elementwise(2, lambda a, b: a.cast("boolean") & b.cast("boolean"), None), "or": lambda m: m.elementwise(2, lambda a, b: a.cast("boolean") | b.cast("boolean"), None),
    "any": lambda m: m.every("any"), "all": lambda m: m.every("all"), "iota": Machine.iota, "like": Machine.like, "spread": Machine.spread, "split": Machine.split, "where": Machine.where, "gather": Machine.gather, "view": Machine.gather, "decompose-view": Machine.decompose_view, "filter": Machine.filter,
    "sort": Machine.sort, "sort.perm": lambda m: m.sort(True), "sort.segmented": Machine.sort_segments, "group": Machine.group, "unique": Machine.unique, "nest": Machine.nest, "nest.stride": Machine.nest_stride, "flatten": Machine.flatten, "concat": lambda m: m.flatten(False),
    "list>bounds": Machine.bounds, "list>ranges": Machine.ranges, "bounds>keys": Machine.keys, "enlist": Machine.enlist, "unlist": Machine.unlist, "count": Machine.count, "head": Machine.head, "reverse": Machine.reverse, "reverse.segmented": lambda m: m.segments(F.reverse),
    "take": lambda m: m.taken(False), "skip": lambda m: m.taken(True), "take.segmented": Machine.take_segments, "view.range": Machine.view_range, "search": Machine.search, "intersect": Machine.intersect, "xprod": Machine.xprod,
}


def register(name: str, arity: int, f) -> None:
    """Add a word: ``f`` takes the top ``arity`` columns' expressions (aligned by position) and returns one.

    Built-in words cannot be replaced.
    """
    if name in WORDS:
        raise StackError(f"{name!r} is taken")

    def word(m: Machine) -> None:
        frame, x = together(*[m.pop() for _ in range(arity)][::-1])
        m.push(Col(frame, f(*x)))

    WORDS[name] = word


def run(spark: SparkSession, source: str, table: DataFrame | None = None) -> list[DataFrame]:
    """The columns a program leaves, deepest first, each as (pos, v).

    The columns of ``table``, numbered by its ``pos`` from 0, are names in the program.
    """
    return Machine(spark).run(source, table)
