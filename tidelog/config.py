"""Engine settings with their defaults and clamps."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    wal_buffer_capacity: int = 10
    wal_water_mark: int = 20
    memtable_size: int = 20
    memtable_structure: str = "b_tree"
    sstable_interval: int = 10
    bloom_falsepositive_rate: float = 2.0
    btree_num_of_children: int = 3
    skiplist_max_height: int = 10
    sstable_file_config: str = "single"
    lsm_max_level: int = 4
    token_cap: int = 25
    token_rate: int = 15
    compaction_type: str = "size_tiered"
    leveled_compaction_multiplier: int = 10
    lru_cap: int = 10

    @classmethod
    def of(cls, **values) -> EngineConfig:
        """Unknown names are refused; values out of range fall back to the default or the nearest bound."""
        known = {f.name: f.default for f in fields(cls)}
        if extra := values.keys() - known.keys():
            raise ValueError(f"unknown settings: {sorted(extra)}")
        v = known | values
        floors = {"wal_buffer_capacity": 2, "wal_water_mark": 10, "memtable_size": 1, "sstable_interval": 1, "btree_num_of_children": 1, "skiplist_max_height": 1, "lsm_max_level": 4, "token_cap": 1, "token_rate": 1, "leveled_compaction_multiplier": 2, "lru_cap": 1}
        for name, least in floors.items():
            if v[name] < least:
                v[name] = known[name]
        v["wal_water_mark"] = min(v["wal_water_mark"], 99_999)
        if v["skiplist_max_height"] > 100:
            v["skiplist_max_height"] = 99
        if v["bloom_falsepositive_rate"] == 0:
            v["bloom_falsepositive_rate"] = known["bloom_falsepositive_rate"]
        choices = {"memtable_structure": ("b_tree", "skiplist"), "sstable_file_config": ("single", "multi"), "compaction_type": ("size_tiered", "leveled")}
        for name, allowed in choices.items():
            if v[name] not in allowed:
                v[name] = known[name]
        return cls(**v)

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        """Settings from a file of `name: value` lines. Unknown names, and values of another type, count as not given."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        values = {}
        with open(path, encoding="utf-8") as file:
            for line in file:
                name, _, value = line.partition("#")[0].partition(":")
                name, value = name.strip(), value.strip().strip("\"'")
                if name in kinds and value:
                    try:
                        values[name] = kinds[name](value)
                    except ValueError:
                        continue
        return cls.of(**values)


#: The shipped settings.
SHIPPED = EngineConfig.of(memtable_size=40, memtable_structure="skiplist", lsm_max_level=7, token_cap=20, token_rate=10, leveled_compaction_multiplier=3, lru_cap=5)
