"""Symbols, imports and calls from source files: the `ast` module for Python, line patterns for other languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import scoring, text
from seamline.sources.shared import materialised

RESULT = "path string, language string, item string, name string, qualified_name string, kind string, parent string, signature string, line_start int, line_end int, target string, label string"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]

#: Definitions by language: kind and pattern of a line whose first group is the name.
PATTERNS = {
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)"), ("constant", r"\b(?:const|static)\s+([A-Z_]\w*)\s*:"), ("type_alias", r"\btype\s+(\w+)")],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("type_alias", r"^type\s+(\w+)\s+(?!struct|interface)\S"), ("constant", r"^const\s+(\w+)"), ("variable", r"^var\s+(\w+)")],
    "typescript": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("function", r"\bfunction\s*\*?\s*(\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\("), ("constant", r"^\s*(?:export\s+)?const\s+(\w+)"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b)(\w+)\s*\([^;]*\)\s*(?::[^;{]*)?\{")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|\s)*[\w<>\[\]]+\s+(\w+)\s*\([^;]*\)\s*\{")],
    "c": [("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"^\s*enum\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;]*\)\s*\{")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)")],
    "swift": [("class", r"\bclass\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("interface", r"\bprotocol\s+(\w+)"), ("function", r"\bfunc\s+(\w+)")],
    "kotlin": [("interface", r"\binterface\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("function", r"\bfun\s+(?:<[^>]*>\s*)?(\w+)")],
}
PATTERNS |= {"javascript": PATTERNS["typescript"], "cpp": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*namespace\s+(\w+)"), *PATTERNS["c"]]}
IMPORTS = {
    "rust": r"^\s*(?:pub\s+)?use\s+([^;]+);",
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$',
    "typescript": r"(?:from\s+|require\(\s*|^\s*import\s+)['\"]([^'\"]+)['\"]",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+);",
    "c": r'^\s*#include\s+[<"]([^>"]+)[>"]',
    "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "swift": r"^\s*import\s+(\w+)",
    "kotlin": r"^\s*import\s+([\w.*]+)",
}
IMPORTS |= {"javascript": IMPORTS["typescript"], "cpp": IMPORTS["c"]}
CALL = re.compile(r"(?<![\w.:])((?:[A-Za-z_]\w*(?:::|\.))*[A-Za-z_]\w*)!?\(")
WORDS = frozenset("if for while switch return match catch fn func function def class struct impl new await async sizeof typeof in not and or elif else except with lambda yield assert del raise print".split())
SCOPES = {"rust": r"\b(?:impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?|trait\s+|mod\s+)(\w+)", "typescript": r"\b(?:class|interface)\s+(\w+)", "java": r"\b(?:class|interface|enum)\s+(\w+)", "cpp": r"\b(?:class|struct|namespace)\s+(\w+)", "ruby": r"^\s*(?:class|module)\s+(\w+)", "swift": r"\b(?:class|struct|extension)\s+(\w+)", "kotlin": r"\b(?:class|object|interface)\s+(\w+)"}
SCOPES["javascript"] = SCOPES["typescript"]


def expand_use(expr: str) -> list[str]:
    """The paths of a nested use: a::{b, c::{d, self}} gives a::b, a::c::d and a::c."""
    expr = expr.strip()
    brace = expr.find("{")
    if brace < 0:
        return [re.sub(r"\s+as\s+\w+$", "", expr)] if expr else []
    prefix, inner, depth, part, out = expr[:brace], expr[brace + 1 : expr.rfind("}")], 0, "", []
    for c in inner + ",":
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            for p in expand_use(part):
                out.append(prefix.rstrip(":") if p == "self" else prefix + p)
            part = ""
        else:
            part += c
    return out


def resolve_relative(path: str, module: str, language: str) -> str | None:
    """The file that a relative import means, without its ending; None for absolute ones."""
    folder = path.split("/")[:-1]
    if language in ("typescript", "javascript") and module.startswith("."):
        parts = module.split("/")
    elif language == "python" and module.startswith("."):
        dots = len(module) - len(module.lstrip("."))
        parts = [".."] * (dots - 1) + [p for p in module.lstrip(".").split(".") if p]
    else:
        return None
    for p in parts:
        if p == "..":
            folder = folder[:-1]
        elif p not in ("", "."):
            folder = [*folder, p]
    return "/".join(folder)


def _row(path: str, language: str, item: str, **values) -> dict:
    return dict.fromkeys(COLUMNS) | {"path": path, "language": language, "item": item} | values


def extract_python(path: str, source: str) -> Iterator[dict]:
    tree = ast.parse(source)
    stack: list[tuple[ast.AST, list[str], str | None]] = [(tree, [], None)]
    all_lines = source.split("\n")
    while stack:
        node, names, owner = stack.pop()
        for child in ast.iter_child_nodes(node):
            inside, kind = names, owner
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                what = "class" if is_class else "method" if owner == "class" else "function"
                first = all_lines[child.lineno - 1].strip()
                yield _row(path, "python", "symbol", name=child.name, qualified_name=".".join([*names, child.name]), kind=what, parent=names[-1] if names else None, signature=None if is_class else first, line_start=child.lineno, line_end=child.end_lineno)
                inside, kind = [*names, child.name], "class" if is_class else "function"
            elif isinstance(child, ast.Assign) and not names:
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        yield _row(path, "python", "symbol", name=t.id, qualified_name=t.id, kind="constant" if t.id.isupper() else "variable", line_start=child.lineno, line_end=child.end_lineno)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield _row(path, "python", "import", target=a.name, line_start=child.lineno)
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    module = "." * child.level + (child.module or "")
                    yield _row(path, "python", "import", target=f"{module}.{a.name}" if module.strip(".") else module + a.name, label=resolve_relative(path, module, "python"), line_start=child.lineno)
            elif isinstance(child, ast.Call):
                name = ast.unparse(child.func)
                if re.fullmatch(r"[\w.]+", name):
                    yield _row(path, "python", "call", target=name, label="heuristic" if "." in name else "static", line_start=child.lineno)
            stack.append((child, inside, kind))


def _block_end(lines: list[str], at: int) -> int:
    """Line (from 0) where the block that opens at a line closes."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        bare = re.sub(r'"(?:\\.|[^"\\])*"|//.*', "", lines[i])
        depth += bare.count("{") - bare.count("}")
        opened |= "{" in bare
        if opened and depth <= 0 or not opened and (bare.rstrip().endswith(";") or i > at + 20):
            return i
    return len(lines) - 1 if opened else at


def extract_lines(path: str, source: str, language: str) -> Iterator[dict]:
    lines, scopes = source.split("\n"), []
    separator = "::" if language == "rust" else "."
    scope_pattern, import_pattern = SCOPES.get(language), IMPORTS.get(language)
    for i, line in enumerate(lines):
        code = line.split("//")[0] if language != "ruby" else line.split("#")[0]
        scopes = [s for s in scopes if s[1] >= i]
        parent = scopes[-1][0] if scopes else None
        if import_pattern and (m := re.search(import_pattern, code)):
            for target in expand_use(m.group(1)) if language == "rust" else [m.group(1)]:
                yield _row(path, language, "import", target=target, label=resolve_relative(path, target, language), line_start=i + 1)
            continue
        found = False
        for kind, pattern in PATTERNS.get(language, ()):
            if m := re.search(pattern, code):
                name, end = m.group(1), _block_end(lines, i)
                if kind == "function" and parent and language != "go":
                    kind = "method"
                receiver = re.match(r"^func\s+\(\s*\w*\s*\*?\s*(\w+)", code) if language == "go" else None
                owner = receiver.group(1) if receiver else parent
                yield _row(path, language, "symbol", name=name, qualified_name=f"{owner}{separator}{name}" if owner else name, kind=kind, parent=owner, signature=code.strip() if kind in ("function", "method") else None, line_start=i + 1, line_end=end + 1)
                found = True
                break
        if scope_pattern and (m := re.search(scope_pattern, code)):
            scopes.append((m.group(1), _block_end(lines, i)))
        for m in CALL.finditer(code):
            name = m.group(1)
            if name.split(".")[-1].split("::")[-1] not in WORDS and not (found and re.search(rf"(fn|func|function|fun|def)\s*(\([^)]*\)\s*)?{re.escape(name)}$", code[: m.end() - 1])):
                yield _row(path, language, "call", target=name, label="heuristic" if "." in name else "static", line_start=i + 1)


#: Files whose rows are held at once.
FILES_AT_ONCE = 1000


def extract(files: DataFrame) -> DataFrame:
    """Symbols, imports and calls of all files (path, language, content), and an `error` row for a file that can't be parsed.

    Files are dealt to all tasks first: a table of them can be small enough to be read by one.
    """
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                rows: list[dict] = []
                part = batch.slice(at, FILES_AT_ONCE)
                for path, language, content in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    try:
                        rows += extract_python(path, content or "") if language == "python" else extract_lines(path, content or "", language)
                    except (SyntaxError, ValueError) as problem:
                        rows.append(_row(path, language, "error", target=str(problem)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c.startswith("line_") else pa.string()) for c in COLUMNS], COLUMNS)

    return files.select("path", "language", "content").repartition(partitions, "path").mapInArrow(run, RESULT)


def symbol_rows(extracted: DataFrame, repo: str, ref: str = "live") -> DataFrame:
    """Symbols with ids. A parent is the innermost symbol of that name around the symbol, else the first earlier one of the file: a type whose methods stand in a block of their own."""
    s = extracted.where("item = 'symbol'").dropDuplicates(["path", "qualified_name", "kind", "line_start"])
    s = s.withColumns({"repo": F.lit(repo), "ref": F.lit(ref)})
    s = s.withColumn("symbol_id", scoring.symbol_id(F.col("repo"), F.col("ref"), F.col("path"), F.col("kind"), F.col("line_start"), F.col("qualified_name")))
    s = s.withColumn("symbol_stable_id", scoring.stable_id(F.col("language"), F.col("kind"), F.col("qualified_name"), F.col("signature")))
    # read several times below; files would be parsed as often
    s = materialised(s, "named")
    owners = s.select("path", F.col("name").alias("parent"), F.col("line_start").alias("p_line"), F.col("line_end").alias("p_end"), F.col("symbol_id").alias("p_id"))
    found = s.select("path", "parent", "symbol_id", "line_start", "line_end").join(owners, ["path", "parent"]).where("p_line < line_start")
    around = F.col("p_end") >= F.col("line_end")
    first = found.groupBy("symbol_id").agg(F.min_by("p_id", F.struct(F.when(around, 0).otherwise(1), F.when(around, -F.col("p_line")).otherwise(F.col("p_line")), F.col("p_id"))).alias("parent_symbol_id"))
    return s.join(first, "symbol_id", "left").withColumn("visibility", F.lit(None).cast("string"))


BODY_KINDS = ("function", "method", "class", "struct", "trait", "interface", "module")


def snippet_rows(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks of the symbols' bodies; files without any get chunks of the whole file."""
    body = symbols.where(F.col("kind").isin(*BODY_KINDS)).select("path", "symbol_id", "kind", "line_start", "line_end")
    content = files.select("path", F.split("content", "\n").alias("all_lines"))

    def chunked(rows: DataFrame, chunk_type, origin: str) -> DataFrame:
        n = F.col("line_end") - F.col("line_start") + 1
        cut = rows.select("*", F.posexplode(text.chunk_bounds(n)).alias("chunk_index", "c"))
        part = F.array_join(F.slice("all_lines", F.col("line_start") + F.col("c.first") - 1, F.col("c.last") - F.col("c.first") + 1), "\n")
        short, over = text.truncate_to_tokens(F.col("part"))
        cut = cut.withColumn("part", part)
        return cut.select("path", "symbol_id", chunk_type.alias("chunk_type"), F.lit(origin).alias("origin"), "chunk_index", (F.col("line_start") + F.col("c.first") - 1).alias("line_start"), (F.col("line_start") + F.col("c.last") - 1).alias("line_end"), short.alias("content"), over.alias("truncated"))

    own = chunked(body.join(content, "path"), F.concat(F.col("kind"), F.lit("_body")), "symbol_origin")
    rest = content.join(body.select("path").distinct(), "path", "left_anti")
    whole = rest.select("path", F.lit(None).cast("string").alias("symbol_id"), F.lit(1).alias("line_start"), F.size("all_lines").alias("line_end"), "all_lines")
    return own.unionByName(chunked(whole, F.lit("file_fallback"), "file_fallback"))
