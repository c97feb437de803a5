"""Differences between a table's header and a new one, and what may be done about them."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from ..config import LoadConfig
from ..functions.typesystem import FLOAT_GROUP, INT_GROUP, collate
from ..header import ColumnDef, Header


@dataclass
class Changes:
    add: dict[str, ColumnDef] = field(default_factory=dict)
    modify: dict[str, ColumnDef] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    nullable: list[str] = field(default_factory=list)
    no_longer_unique: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)

    def exist(self) -> bool:
        return any((self.add, self.modify, self.drop, self.rename, self.nullable, self.no_longer_unique, self.primary_key))

    def as_json(self) -> dict:
        return {
            "add": {n: c.as_dict() for n, c in self.add.items()}, "modify": {n: c.as_dict() for n, c in self.modify.items()}, "drop": self.drop,
            "rename": self.rename, "nullable": self.nullable, "no_longer_unique": self.no_longer_unique, "primary_key": self.primary_key,
        }


def merged_size(old: ColumnDef, new: ColumnDef, kind: str) -> tuple[int, int]:
    """Length and scale that hold both; whole digits and scale of decimals grow apart from each other."""
    scale = max(old.decimal, new.decimal)
    if kind in FLOAT_GROUP or kind == "numeric":
        return max(old.length - old.decimal, new.length - new.decimal) + scale, scale
    return max(old.length, new.length), 0 if kind in INT_GROUP else scale


def _renames(old: Header, new: Header, gone: list[str], come: list[str]) -> dict[str, str]:
    """Columns that went under one name and came under another: only where one definition fits one on each side."""
    prints = {n: repr(sorted(h[n].as_dict().items())) for h, names in ((old, gone), (new, come)) for n in names}
    before, after = Counter(prints[n] for n in gone), Counter(prints[n] for n in come)
    by_print = {prints[n]: n for n in come}
    return {n: by_print[prints[n]] for n in gone if before[prints[n]] == 1 and after.get(prints[n]) == 1}


def compare(old: Header | None, new: Header, config: LoadConfig | None = None) -> tuple[Changes, Header]:
    """Changes that lead from ``old`` to a header that holds both, and that header.

    Types only widen, NOT NULL and uniqueness only relax, and columns that are
    not in the new data stay unless the caller deletes them.
    """
    changes = Changes()
    if old is None:
        return changes, new.copy()
    gone = [n for n in old if n not in new]
    come = [n for n in new if n not in old]
    changes.rename = _renames(old, new, gone, come)
    merged = Header()
    for n, c in old.items():
        merged[changes.rename.get(n, n)] = c
    changes.drop = [n for n in gone if n not in changes.rename]
    for n in come:
        if n in changes.rename.values():
            continue
        c = new[n]
        fill = c.auto_increment or c.calculated or c.default is not None or c.calculated_default is not None
        changes.add[n] = merged[n] = c.with_(allow_null=c.allow_null or not fill, primary=c.primary and c.auto_increment)
    for n, was in old.items():
        if n not in new:
            continue
        c = new[n]
        kind = collate([was.type, c.type])
        length, scale = merged_size(was, c, kind)
        null = was.allow_null or (c.allow_null and not was.primary)
        now = was.with_(type=kind, length=length, decimal=scale, allow_null=null, previous_type=was.type if kind != was.type else was.previous_type)
        if was.unique and not c.unique:
            now = now.with_(unique=False)
            changes.no_longer_unique.append(n)
        if null and not was.allow_null:
            changes.nullable.append(n)
        now = now.with_(pseudounique=was.pseudounique or c.pseudounique, index=was.index or c.index, categorical=was.categorical and c.categorical, single_value=was.single_value and c.single_value)
        merged[n] = now
        if kind != was.type or length > was.length or (kind == "decimal" and scale > was.decimal):
            changes.modify[n] = now
    keys, asked = old.primary_keys, new.primary_keys
    if asked and [k for k in asked if k not in keys]:
        changes.primary_key = list(dict.fromkeys([*keys, *asked]))
    return changes, merged


def blocked(changes: Changes, config: LoadConfig) -> list[str]:
    """What the data asks for and the configuration does not allow."""
    out = []
    if changes.drop and not config.delete_columns:
        out.append(f"columns absent from the data are kept (delete_columns is off): {', '.join(changes.drop)}")
    if changes.primary_key and not config.update_primary_key:
        out.append(f"the primary key is kept (update_primary_key is off); the data suggests: {', '.join(changes.primary_key)}")
    if changes.no_longer_unique and not config.drop_unique_constraints:
        out.append(f"unique columns stay so (drop_unique_constraints is off): {', '.join(changes.no_longer_unique)}")
    if config.safe_mode and changes.exist():
        out.append("safe_mode: the table's schema is not changed")
    return out


def apply_gates(old: Header | None, changes: Changes, merged: Header, config: LoadConfig) -> Header:
    """The header that a load ends with, after what is not allowed is taken out of the changes."""
    if old is None:
        return merged
    if config.safe_mode:
        return old.copy()
    out = merged.copy()
    for n in changes.drop:
        if config.delete_columns:
            out.pop(n, None)
    for n in changes.no_longer_unique:
        if not config.drop_unique_constraints:
            out.change(n, unique=True)
    if changes.primary_key and config.update_primary_key:
        for n in out:
            out.change(n, primary=n in changes.primary_key)
    return out


def warnings_of(changes: Changes) -> list[str]:
    """What a roll-back could not restore on a target that changes in place (D13); previews show it beside the statements."""
    return [f"dropped column {n} could not be restored" for n in changes.drop] + [f"{n} was made nullable" for n in changes.nullable]
