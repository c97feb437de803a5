"""Statement texts for a preview (D9, D10, D18, D21, D22, E1-E4).  The engine itself applies headers, not statements."""

from __future__ import annotations

import re

from ..config import LoadConfig
from ..header import ColumnDef, Header, constraint_name
from .diff import Changes

TYPE_TOKEN = re.compile(r"[A-Za-z][A-Za-z0-9_ ]{0,62}(?:\([0-9]+(?:,\s*[0-9]+)?\))?\Z")
SAFE_DEFAULT = re.compile(r"(?:'[^'\;]*'|-?[0-9]+(?:\.[0-9]+)?|NULL|TRUE|FALSE|CURRENT_TIMESTAMP|CURRENT_DATE|UUID\(\))\Z", re.IGNORECASE)


def quote_identifier(name: str, config: LoadConfig | None = None) -> str:
    """Name in backticks; empty, over-long and NUL-bearing names are refused."""
    limit = config.profile.identifier_limit if config else 255
    if not name or "\x00" in name or len(name.encode()) > limit:
        raise ValueError(f"not a usable identifier: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def quote_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value)
    if "\x00" in text:
        raise ValueError("a literal must not have NUL")
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def safe_type(token: str) -> str:
    if not TYPE_TOKEN.match(token):
        raise ValueError(f"not a type: {token!r}")
    return token


def safe_length(value: object, label: str = "length") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{label} must be a whole number: {value!r}")
    return value


def safe_default(text: str) -> str:
    """A default that is a literal or a known call; anything else is refused."""
    if not SAFE_DEFAULT.match(text.strip()):
        raise ValueError(f"not a safe default: {text!r}")
    return text.strip()


def single_statement(sql: str) -> bool:
    """Whether a text is one statement: a semicolon outside quotes and comments may only end it."""
    token = re.compile(
        r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|\$([A-Za-z_]*)\$.*?\$\1\$|;|[^'\"`;/$-]+|.", re.DOTALL
    )
    ended = seen = False
    for m in token.finditer(sql):
        part = m.group(0)
        if part == ";":
            ended = seen
        elif part.startswith(("--", "/*")) or not part.strip():
            continue
        elif part in ("'", '"', "`") or ended:  # an unclosed quote, or text after the end
            return False
        else:
            seen = True
    return seen


def render_type(c: ColumnDef) -> str:
    return safe_type(c.data_type.simpleString() if c.type != "varchar" or not c.length else f"varchar({safe_length(c.length)})")


def column_text(name: str, c: ColumnDef, config: LoadConfig) -> str:
    out = f"{quote_identifier(name, config)} {render_type(c)}"
    if not c.allow_null:
        out += " NOT NULL"
    default = c.ddl_default if c.ddl_default is not None else None if c.default is None else quote_literal(c.default)
    return out + (f" DEFAULT {safe_default(default)}" if default is not None else "")


def create_table(table: str, header: Header, config: LoadConfig) -> list[str]:
    lines = [column_text(n, c, config) for n, c in header.items()]
    if header.primary_keys:
        lines.append("PRIMARY KEY (" + ", ".join(quote_identifier(k, config) for k in header.primary_keys) + ")")
    slots = config.profile.max_indexes - 1
    for n in header.unique_columns[:slots]:
        lines.append(f"CONSTRAINT {quote_identifier(constraint_name(table, n), config)} UNIQUE ({quote_identifier(n, config)})")
        slots -= 1
    for n, c in header.items():
        if c.index and not c.unique and not c.primary and slots > 0:
            lines.append(f"INDEX {quote_identifier(constraint_name(table, n, 'index'), config)} ({quote_identifier(n, config)})")
            slots -= 1
    return [f"CREATE TABLE IF NOT EXISTS {quote_identifier(table, config)} (\n  " + ",\n  ".join(lines) + "\n)"]


def alter_table(table: str, old: Header, new: Header, changes: Changes, config: LoadConfig) -> list[str]:
    t = f"ALTER TABLE {quote_identifier(table, config)}"
    out = [f"{t} RENAME COLUMN {quote_identifier(a, config)} TO {quote_identifier(b, config)}" for a, b in changes.rename.items()]
    out += [f"{t} ADD COLUMN {column_text(n, new[n], config)}" for n in changes.add if n in new]
    out += [f"{t} ALTER COLUMN {quote_identifier(n, config)} TYPE {render_type(new[n])}" for n in changes.modify if n in new]
    out += [f"{t} ALTER COLUMN {quote_identifier(n, config)} DROP NOT NULL" for n in changes.nullable]
    if config.delete_columns:
        out += [f"{t} DROP COLUMN {quote_identifier(n, config)}" for n in changes.drop]
    if config.drop_unique_constraints:
        out += [f"{t} DROP CONSTRAINT {quote_identifier(old[n].unique_name or constraint_name(table, n), config)}" for n in changes.no_longer_unique]
    if config.update_primary_key and changes.primary_key:
        out += [f"{t} DROP PRIMARY KEY", f"{t} ADD PRIMARY KEY ({', '.join(quote_identifier(n, config) for n in changes.primary_key)})"]
    return out


def drop_table(table: str, config: LoadConfig) -> list[str]:
    return [f"DROP TABLE IF EXISTS {quote_identifier(table, config)}"]
