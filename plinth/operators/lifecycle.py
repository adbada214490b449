"""What surrounds single changes: transactions over the catalog, migrations, events, retries and rows as objects.

Tables are immutable and a change puts a new version under their name. So a transaction is a copy of
the names, and giving it up puts the old versions back.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import functions as F

from . import dml


class Transactions:
    """For Database: all changes of tables inside transaction() hold or none does."""

    def _begin(self) -> None:
        self._saved = getattr(self, "_saved", [])
        self._saved.append(("", dict(self.tables)))

    @contextmanager
    def transaction(self) -> Iterator[Any]:
        """Inside another one it is a part of it: only its own changes are given up with it."""
        self._begin()
        depth = len(self._saved)
        self.events.emit("begin", depth=depth)
        try:
            yield self
        except BaseException:
            self._restore(self._saved[depth - 1][1])
            self.events.emit("rollback", depth=depth)
            raise
        else:
            self.events.emit("commit", depth=depth)
        finally:
            del self._saved[depth - 1 :]

    def in_transaction(self) -> bool:
        return bool(getattr(self, "_saved", []))

    def savepoint(self, name: str) -> None:
        if not self.in_transaction():
            raise ValueError("no transaction")
        self._saved.append((name, dict(self.tables)))

    def rollback_to(self, name: str) -> None:
        """The newest savepoint of that name, which stays; those after it go."""
        at = self._savepoint(name)
        self._restore(self._saved[at][1])
        del self._saved[at + 1 :]

    def release_savepoint(self, name: str) -> None:
        del self._saved[self._savepoint(name) :]

    def savepoints(self) -> list[str]:
        return [n for n, _ in getattr(self, "_saved", []) if n]

    def _savepoint(self, name: str) -> int:
        found = [k for k, (n, _) in enumerate(getattr(self, "_saved", [])) if n == name]
        if not found or not name:
            raise ValueError(f"no savepoint {name!r}")
        return found[-1]

    def _restore(self, tables: dict) -> None:
        changed = {n for n in {*tables, *self.tables} if tables.get(n) is not self.tables.get(n)}
        self.tables = dict(tables)
        self.cache.invalidate_tables(*changed)


class Events:
    """Functions called with what has happened: query, change, begin, commit, rollback, migrated, or a name of the user's."""

    def __init__(self) -> None:
        self.listeners: dict[str, list[Callable[..., None]]] = {}

    def listen(self, event: str, function: Callable[..., None]) -> None:
        self.listeners.setdefault(event, []).append(function)

    def emit(self, event: str, **given: Any) -> None:
        for function in self.listeners.get(event, ()):
            function(**given)


def retry(action: Callable[[], Any], attempts: int = 3, wait: float = 0.1, factor: float = 2.0, longest: float = 10.0, on: tuple[type[BaseException], ...] = (Exception,)) -> Any:
    """Run `action` again after an error of a type in `on`, waiting longer each time; the last error is raised. Lost tasks are Spark's own to run again."""
    for k in range(attempts):
        try:
            return action()
        except on:
            if k == attempts - 1:
                raise
            time.sleep(min(longest, wait * factor**k))


class Migrations:
    """Named steps up and down. What has run is in a table of the catalog, so that it is dumped, restored and rolled back with the rest."""

    TABLE = "migrations"

    def __init__(self, db: Any) -> None:
        self.db, self.steps = db, {}

    def add(self, name: str, up: Callable[[Any], Any], down: Callable[[Any], Any] | None = None) -> None:
        self.steps[name] = (up, down)

    def history(self) -> list[tuple[str, int]]:
        """(name, batch) of what has run, in order."""
        if not self.db.table_exists(self.TABLE):
            return []
        return [(r["name"], r["batch"]) for r in self.db.frame(self.TABLE).orderBy("batch", "name").collect()]

    def new(self) -> list[str]:
        done = {name for name, _ in self.history()}
        return sorted(n for n in self.steps if n not in done)

    def migrate(self, limit: int = 0, dry_run: bool = False) -> list[str]:
        """Run new steps in the order of their names, all (or `limit`) as one batch; each holds as a whole or not at all."""
        names = self.new()[: limit or None]
        if dry_run:
            return names
        batch = 1 + max((b for _, b in self.history()), default=0)
        for name in names:
            with self.db.transaction():
                self.steps[name][0](self.db)
                self.db.create_table(self.TABLE, {"name": "string", "batch": "integer"}, if_not_exists=True)
                self.db.put(self.TABLE, dml.insert(self.db.frame(self.TABLE), {"name": name, "batch": batch}))
            self.db.events.emit("migrated", name=name, up=True)
        return names

    def down(self, steps: int = 1) -> list[str]:
        """Undo the last steps, the newest first."""
        names = [name for name, _ in self.history()][::-1][:steps]
        for name in names:
            if name not in self.steps or self.steps[name][1] is None:
                raise ValueError(f"no way back from {name!r}")
            with self.db.transaction():
                self.steps[name][1](self.db)
                self.db.put(self.TABLE, dml.delete(self.db.frame(self.TABLE), F.col("name") == name))
            self.db.events.emit("migrated", name=name, up=False)
        return names


class Record:
    """A row as an object. save() writes what has changed since it was read; each save is a new version of the whole table, so use it for few rows and dml for many."""

    def __init__(self, db: Any, table: str, values: dict[str, Any], key: str = "id", new: bool = True) -> None:
        self.__dict__.update(_db=db, _table=table, _key=key, _values=dict(values), _old={} if new else dict(values), _new=new)

    @classmethod
    def find(cls, db: Any, table: str, value: Any, key: str = "id") -> Record | None:
        row = db.frame(table).filter(F.col(key) == F.lit(value)).first()
        return None if row is None else cls(db, table, row.asDict(), key, new=False)

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["_values"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value: Any) -> None:
        self._values[name] = value

    def dirty(self) -> dict[str, Any]:
        return {k: v for k, v in self._values.items() if k not in self._old or self._old[k] != v}

    def _put(self, change: Callable) -> None:
        self._db.find(self._table)._changed(change)

    def save(self, rules: dict[str, Callable[[Any], bool]] | None = None) -> bool:
        """False, and nothing is written, where a rule of a column does not hold."""
        if any(not rule(self._values.get(name)) for name, rule in (rules or {}).items()):
            return False
        changed = self.dirty()
        if self._new:
            self._put(lambda t: dml.insert(t, self._values))
        elif changed:
            self._put(lambda t: dml.update(t, changed, F.col(self._key) == F.lit(self._old[self._key])))
        self.__dict__.update(_old=dict(self._values), _new=False)
        return True

    def delete(self) -> None:
        self._put(lambda t: dml.delete(t, F.col(self._key) == F.lit(self._old[self._key])))
        self.__dict__.update(_new=True, _old={})

    def refresh(self) -> None:
        again = Record.find(self._db, self._table, self._values[self._key], self._key)
        if again is None:
            raise ValueError("the row is gone")
        self.__dict__.update(_values=again._values, _old=dict(again._values), _new=False)
