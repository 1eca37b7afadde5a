"""SQL sessions: MySQL-flavoured definitions and changes, Spark SQL for queries, roles, variables and the scan guard."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import TTL, Column, Index, Table, index_options, refuse, table_options
from .engine import Engine
from .errors import InvalidDefinition, ReadOnly, TableError
from .plans.gate import check_scan, filtered_columns

VARIABLES = {"query_allow_fullscan_tables": "", "replica_read": "OFF", "hotkey_row_cache": "OFF"}
_REFUSED = re.compile(
    r"(TRUNCATE|GRANT|REVOKE|RENAME|ALTER|BEGIN|START\s+TRANSACTION|SAVEPOINT|ROLLBACK|COMMIT|LOCK|LOAD|CREATE\s+(VIEW|TRIGGER|PROCEDURE|FUNCTION|DATABASE|USER)|CALL)\b", re.I
)
_TOKEN = re.compile(r"""\s*('(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|`[^`]+`|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|<=|>=|<>|!=|.)""", re.S)


def tokens(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.strip()) if t.strip()]


def split(text: str, by: str = ",") -> list[str]:
    """Parts between separators that stand outside of quotes and brackets."""
    parts, depth, start, at = [], 0, 0, 0
    while at < len(text):
        ch = text[at]
        if ch in "'\"`":
            end = at + 1
            while end < len(text) and text[end] != ch:
                end += 2 if text[end] == "\\" and ch != "`" else 1
            at = end
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth -= 1
        elif ch == by and not depth:
            parts.append(text[start:at])
            start = at + 1
        at += 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


_QUOTED = r"""'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*\""""


def masked(text: str) -> str:
    """The text with what stands in quotes replaced, place by place, so that only what stands outside can match."""
    return re.sub(_QUOTED, lambda m: m[0][0] + "_" * (len(m[0]) - 2) + m[0][-1], text, flags=re.S)


def outside(pattern: str, put: str | Callable[[re.Match], str], text: str) -> str:
    """Substitutes a pattern outside of quotes; upper and lower case alike."""
    found = re.compile(pattern, re.I | re.S)
    return re.sub(rf"({_QUOTED})|(?:{pattern})", lambda m: m[0] if m[1] is not None else found.sub(put, m[0]), text, flags=re.I | re.S)


class Parts:
    """Groups of a pattern that has matched the masked text, taken from the text itself."""

    def __init__(self, text: str, match: re.Match):
        self.text, self.match = text, match

    def __getitem__(self, i: int) -> str | None:
        a, b = self.match.span(i)
        return self.text[a:b] if a >= 0 else None


def bare(name: str) -> str:
    return name.strip().strip("`").split(".")[-1].strip("`")


def quoted(text: str) -> str:
    return text[1:-1].replace("''", "'").replace('\\"', '"').replace("\\'", "'")


class Session:
    """Statements of one user. ``role`` is "rw" or "ro"; variables are kept beside the tables, for all sessions."""

    def __init__(self, engine: Engine, role: str = "rw", scan_limit: int = 100_000):
        self.engine, self.role, self.scan_limit = engine, role, scan_limit
        self.spark = engine.spark

    # variables

    def _variables_path(self):
        return self.engine.store._path("_variables.json")

    def variables(self) -> dict[str, str]:
        fs, path = self.engine.store._fs(), self._variables_path()
        if not fs.exists(path):
            return dict(VARIABLES)
        stream = fs.open(path)
        try:
            return VARIABLES | json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def set_global(self, name: str, value: str) -> None:
        self._writable()
        if name.lower() not in VARIABLES:
            raise InvalidDefinition(f"no variable {name}")
        if name.lower() != "query_allow_fullscan_tables":
            value = "ON" if value.strip().upper() in ("ON", "1", "TRUE") else "OFF"
        changed = self.variables() | {name.lower(): value}
        out = self.engine.store._fs().create(self._variables_path(), True)
        try:
            out.write(bytearray(json.dumps(changed).encode()))
        finally:
            out.close()

    def _writable(self) -> None:
        if self.role == "ro":
            raise ReadOnly("the session may only read")

    # statements

    def sql(self, text: str, args: Sequence | None = None) -> DataFrame:
        """Runs a statement. Queries give their rows, changes one row with the number of affected rows."""
        text = text.strip().rstrip(";").strip()
        plain = masked(text)
        for pattern, write, run in self._statements():
            m = pattern.match(plain)
            if m:
                if write:
                    self._writable()
                return run(Parts(text, m), args)
        if _REFUSED.match(text):
            refuse(text.split()[0].upper())
        if re.match(r"(SELECT|WITH|VALUES|\()", text, re.I):
            return self._select(text, args)
        if re.match(r"EXPLAIN\b", text, re.I):
            return self._explain(text, args)
        raise TableError(f"not understood: {text[:60]}")

    def _statements(self) -> list[tuple[re.Pattern, bool, Callable]]:
        flags = re.I | re.S
        tail = r"(?:\s+WHERE\s+(.*?))?(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+LIMIT\s+(\d+|\?))?"
        return [
            (re.compile(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?([`\w.]+)\s*\((.*)\)([^)]*)$", flags), True, self._create_table),
            (re.compile(r"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?([`\w.]+)$", flags), True, self._drop_table),
            (re.compile(r"CREATE\s+(UNIQUE\s+)?INDEX\s+([`\w]+)\s+ON\s+([`\w.]+)\s*\(([^)]*)\)\s*(?:COMMENT\s+('.*'))?$", flags), True, self._create_index),
            (re.compile(r"DROP\s+INDEX\s+([`\w]+)\s+ON\s+([`\w.]+)$", flags), True, self._drop_index),
            (re.compile(r"(INSERT(?:\s+IGNORE)?|REPLACE)\s+(?:INTO\s+)?([`\w.]+)\s*(?:\(([^)]*)\))?\s*((?:VALUES?\b|SELECT\b).*)$", flags), True, self._insert),
            (re.compile(r"(INSERT(?:\s+IGNORE)?|REPLACE)\s+(?:INTO\s+)?([`\w.]+)\s+SET\s+(.*?)(\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\s+.*)?$", flags), True, self._insert_set),
            (re.compile(rf"UPDATE\s+([`\w.]+)\s+SET\s+(.*?){tail}$", flags), True, self._update),
            (re.compile(rf"DELETE\s+FROM\s+([`\w.]+){tail}$", flags), True, self._delete),
            (re.compile(r"(?:DESCRIBE|DESC|SHOW\s+(?:FULL\s+)?(?:COLUMNS|FIELDS)\s+(?:FROM|IN))\s+([`\w.]+)$", flags), False, self._describe),
            (re.compile(r"SHOW\s+(?:INDEX|INDEXES|KEYS)\s+(?:FROM|IN)\s+([`\w.]+)$", flags), False, self._show_index),
            (re.compile(r"SHOW\s+CREATE\s+TABLE\s+([`\w.]+)$", flags), False, self._show_create),
            (re.compile(r"SHOW\s+STATUS$", flags), False, lambda m, a: self._rows(self.engine.metrics.rows(), "name string, value double")),
            (re.compile(r"SET\s+(?:GLOBAL\s+|@@GLOBAL\.)(\w+)\s*=\s*(.+)$", flags), True, self._set_global),
            (re.compile(r"SET\s+(?:SESSION\s+|@@)?autocommit\s*=\s*(\w+)$", flags), False, self._autocommit),
            (re.compile(r"SHOW\s+TABLES$", flags), False, lambda m, a: self._rows([(n,) for n in self.engine.tables()], "name string")),
            (re.compile(r"SHOW\s+(DATABASES|SCHEMAS)$", flags), False, lambda m, a: self._rows([("main",)], "name string")),
            (re.compile(r"SHOW\s+(?:GLOBAL\s+)?VARIABLES(?:\s+LIKE\s+'([^']*)')?$", flags), False, self._show_variables),
        ]

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _affected(self, n: int) -> DataFrame:
        return self._rows([(n,)], "affected long")

    def _show_variables(self, m, args) -> DataFrame:
        pattern = re.compile((m[1] or "%").replace("%", ".*").replace("_", "."), re.I)
        return self._rows([x for x in sorted(self.variables().items()) if pattern.fullmatch(x[0])], "name string, value string")

    def _set_global(self, m, args) -> DataFrame:
        value = m[2].strip()
        self.set_global(m[1], quoted(value) if value[0] in "'\"" else value)
        return self._affected(0)

    def _autocommit(self, m, args) -> DataFrame:
        if m[1].upper() in ("0", "OFF", "FALSE"):
            refuse("autocommit = 0")
        return self._affected(0)

    # definitions

    def _create_table(self, m, args) -> DataFrame:
        name = bare(m[2])
        if m[1] and name in self.engine.tables():
            return self._affected(0)
        comment = re.search(r"COMMENT\s*=?\s*('(?:[^']|'')*')", m[4], re.I)
        columns, keys, indexes, auto = [], [], [], False
        for part in split(m[3]):
            words = tokens(part)
            head = words[0].upper()
            if head == "PRIMARY":
                inner = re.search(r"\(([^)]*)\)", part)[1]
                keys += [bare(x) for x in split(inner)]
            elif head in ("INDEX", "KEY", "UNIQUE"):
                i = re.match(r"(UNIQUE\s+)?(?:(?:INDEX|KEY)\s*)?([`\w]+)\s*\(([^)]*)\)\s*(?:COMMENT\s+('(?:[^']|'')*'))?$", part, re.I | re.S)
                if not i:
                    raise InvalidDefinition(part)
                indexes.append(self._index(bare(i[2]), i[3], bool(i[1]), i[4]))
            else:
                c = re.match(r"([`\w]+)\s+(\w+(?:\s*\([^)]*\))?(?:\s+unsigned)?)(.*)$", part, re.I | re.S)
                if not c:
                    raise InvalidDefinition(part)
                rest = c[3].upper()
                for word in ("DEFAULT", "ON UPDATE", "COLLATE", "GENERATED", "CHECK", "REFERENCES"):
                    if word in rest and not (word == "DEFAULT" and "DEFAULT NULL" in rest):
                        refuse(f"{word} on a column")
                columns.append(Column(bare(c[1]), c[2], "NOT NULL" in rest))
                if "PRIMARY" in rest:
                    keys.append(bare(c[1]))
                if "UNIQUE" in rest:
                    indexes.append(Index(f"uniq_{bare(c[1])}", bare(c[1]), unique=True))
                auto |= "AUTO_INCREMENT" in rest
        if len(keys) != 1:
            raise InvalidDefinition("a table has exactly one primary-key column")
        table = Table(name, columns, keys[0], auto, table_options(quoted(comment[1]) if comment else None), indexes)
        self.engine.create_table(table)
        return self._affected(0)

    def _index(self, name: str, columns: str, unique: bool, comment: str | None) -> Index:
        parts = split(columns)
        if len(parts) != 1:
            raise InvalidDefinition("an index has one column")
        covering, asynchronous = index_options(quoted(comment) if comment else None)
        return Index(name, bare(parts[0].split()[0]), unique, covering, asynchronous)

    def _create_index(self, m, args) -> DataFrame:
        self.engine.create_index(bare(m[3]), self._index(bare(m[2]), m[4], bool(m[1]), m[5]))
        return self._affected(0)

    def _drop_index(self, m, args) -> DataFrame:
        self.engine.drop_index(bare(m[2]), bare(m[1]))
        return self._affected(0)

    def _drop_table(self, m, args) -> DataFrame:
        name = bare(m[2])
        if not (m[1] and name not in self.engine.tables()):
            self.engine.drop_table(name)
        return self._affected(0)

    # changes

    def _insert(self, m, args) -> DataFrame:
        name, body = bare(m[2]), m[4]
        table = self.engine.definition(name)
        found = re.search(r"\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\s+(.*)$", masked(body), re.I | re.S)
        on_duplicate = Parts(body, found) if found else None
        if found:
            body = body[: found.start()]
        columns = [bare(c) for c in split(m[3])] if m[3] else list(table.names)
        if re.match(r"VALUES?\b", body, re.I):
            body = re.sub(r"^VALUES?\b", "VALUES", body, flags=re.I)
        if len(columns) == len(table.names) and not m[3] and re.match(r"VALUES", body):
            width = len(split(split(body[6:])[0][1:-1]))
            columns += [TTL] * (width == len(table.names) + 1)
        self._views(body)
        left = list(args or [])
        rows = self.spark.sql(f"SELECT * FROM ({self._bound(body, left)}) AS t({', '.join(f'`{c}`' for c in columns)})")
        kind = m[1].upper().split()
        if kind[0] == "REPLACE":
            n = self.engine.insert(name, rows, "replace")
        elif on_duplicate:
            set_ = {}
            for part in split(self._bound(on_duplicate[1], left)):
                target, _, value = part.partition("=")
                value = outside(r"VALUES\s*\(\s*`?(\w+)`?\s*\)", r"new.\1", value)
                names = "|".join(map(re.escape, table.names))
                value = outside(rf"(?<![\w.'])`?({names})`?(?![\w'(])", r"old.\1", value)
                set_[table.column(bare(target)).name] = F.expr(value)
            n = self.engine.insert(name, rows, "update", set_)
        else:
            n = self.engine.insert(name, rows, "ignore" if len(kind) > 1 else "error")
        return self._affected(n)

    def _insert_set(self, m, args) -> DataFrame:
        parts = [part.partition("=") for part in split(m[3])]
        columns = ", ".join(f"`{bare(target)}`" for target, _, _ in parts)
        return self.sql(f"{m[1]} INTO {m[2]} ({columns}) VALUES ({', '.join(value for _, _, value in parts)}){m[4] or ''}", args)

    def _update(self, m, args) -> DataFrame:
        left, ttl, set_ = list(args or []), None, {}
        for part in split(self._bound(m[2], left)):
            target, _, value = part.partition("=")
            if bare(target) == TTL:
                ttl = int(value)
            else:
                set_[bare(target)] = F.expr(value)
        where, narrow = self._hit(m, 3, left)
        return self._affected(self.engine.update(bare(m[1]), where, set_, ttl, narrow))

    def _delete(self, m, args) -> DataFrame:
        where, narrow = self._hit(m, 2, list(args or []))
        return self._affected(self.engine.delete(bare(m[1]), where, narrow))

    def _hit(self, m, at: int, left: list):
        """The condition of a change, and what its ORDER BY and LIMIT make of the rows hit."""
        where, order, limit = (self._bound(m[at + i], left) if m[at + i] else None for i in range(3))
        if not order and not limit:
            return F.expr(where) if where else None, None
        keys = []
        for part in split(order or ""):
            name, down = re.match(r"(.*?)(\s+DESC|\s+ASC)?$", part, re.I | re.S).groups()
            keys.append(F.expr(name).desc() if (down or "").strip().upper() == "DESC" else F.expr(name).asc())
        keys.append(F.col(self.engine.definition(bare(m[1])).key).asc())  # ties by key, so that reruns agree
        return F.expr(where) if where else None, lambda hit: hit.orderBy(*keys).limit(int(limit)) if limit else hit

    def _bound(self, text: str, left: list) -> str:
        """Puts literals in the place of ? outside of quotes, and takes them from the list."""
        literal = lambda v: "NULL" if v is None else repr(v) if isinstance(v, int | float) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
        return outside(r"\?", lambda m: literal(left.pop(0)), text)

    # what there is

    def _describe(self, m, args) -> DataFrame:
        table = self.engine.definition(bare(m[1]))
        kinds = {i.column: "UNI" if i.unique else "MUL" for i in reversed(table.indexes)} | {table.key: "PRI"}
        rows = [
            (c.name, c.type_text.lower(), "NO" if c.not_null or c.name == table.key else "YES", kinds.get(c.name, ""), None, "auto_increment" if table.auto_increment and c.name == table.key else "")
            for c in table.columns
        ]
        return self._rows(rows, "Field string, Type string, `Null` string, Key string, Default string, Extra string")

    def _show_index(self, m, args) -> DataFrame:
        table = self.engine.definition(bare(m[1]))
        rows = [(table.name, 0, "PRIMARY", 1, table.key, "PRIMARY")]
        rows += [(table.name, int(not i.unique), i.name, 1, i.column, i.kind) for i in table.indexes]
        return self._rows(rows, "Table string, Non_unique int, Key_name string, Seq_in_index int, Column_name string, Index_type string")

    def _show_create(self, m, args) -> DataFrame:
        table = self.engine.definition(bare(m[1]))
        lines = []
        for c in table.columns:
            auto = " AUTO_INCREMENT" if table.auto_increment and c.name == table.key else ""
            lines.append(f"  `{c.name}` {c.type_text.lower()}{' NOT NULL' if c.not_null else ''}{auto}")
        lines.append(f"  PRIMARY KEY (`{table.key}`)")
        for i in table.indexes:
            options = ({"covering": i.covering} if i.covering else {}) | ({"async": True} if i.asynchronous else {})
            comment = f" COMMENT 'o:{json.dumps(options)}'" if options else ""
            lines.append(f"  {'UNIQUE ' if i.unique else ''}KEY `{i.name}` (`{i.column}`){comment}")
        comment = " COMMENT='o:" + json.dumps({"default_ttl": table.default_ttl}) + "'" if table.default_ttl else ""
        return self._rows([(table.name, f"CREATE TABLE `{table.name}` (\n" + ",\n".join(lines) + f"\n){comment}")], "Table string, `Create Table` string")

    def _explain(self, text: str, args: Sequence | None) -> DataFrame:
        """The plan of a query, or of the rows that a change reads."""
        body = re.sub(r"^EXPLAIN\s+(?:(?:EXTENDED|FORMATTED|ANALYZE)\s+)?", "", text, flags=re.I)
        plain = masked(body)
        change = re.match(r"(?:UPDATE\s+([`\w.]+)\s+SET\s+.*?|DELETE\s+FROM\s+([`\w.]+))(\s+WHERE\s+.*?)?(\s+ORDER\s+BY\s+.*?)?(\s+LIMIT\s+\d+)?$", plain, re.I | re.S)
        if change:
            m = Parts(body, change)
            body = f"SELECT * FROM {m[1] or m[2]}{m[3] or ''}{m[4] or ''}{m[5] or ''}"
        elif re.match(r"(INSERT|REPLACE)\b", plain, re.I):
            source = re.search(r"\b(SELECT|VALUES?)\b.*$", plain, re.I | re.S)
            body = re.sub(r"^VALUE\b", "VALUES", body[source.start() :], flags=re.I) if source else "SELECT 1"
        self._views(body)
        return self.spark.sql("EXPLAIN " + self._bound(body, list(args or [])))

    # queries

    def _views(self, text: str) -> list[str]:
        plain = masked(text)
        used = [n for n in self.engine.tables() if re.search(rf"(?<![\w.']){re.escape(n)}(?!\w)", plain, re.I)]
        for name in used:
            self.engine.table(name).createOrReplaceTempView(name)
        return used

    def _select(self, text: str, args: Sequence | None) -> DataFrame:
        text = outside(r"\b(FROM|JOIN)(\s+)`?\w+`?\.(`?\w+`?)", r"\1\2\3", text)
        used = self._views(text)
        out = self.spark.sql(text, args=list(args) if args else None)
        self._guard(out, text, used)
        return out

    def _guard(self, out: DataFrame, text: str, used: list[str]) -> None:
        """Refuses plans that read a large table without a filter on its key or an indexed column."""
        if re.match(r"SELECT\s+COUNT\(\s*\*\s*\)(\s+AS\s+\w+|\s+\w+)?\s+FROM\s+\S+$", text, re.I):
            return
        for name in used:
            rows = self.engine.store.load(name).rows
            if rows is not None and rows < self.scan_limit:
                continue
            table = self.engine.definition(name)
            if not filtered_columns(out, name) & {table.key.lower(), *(i.column.lower() for i in table.indexes)}:
                check_scan(name, self.engine.row_count(name), self.variables()["query_allow_fullscan_tables"], self.scan_limit)
