"""Settings of a scan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from siftline import catalogue as C


@dataclass(frozen=True)
class ScanConfig:
    include: list[str] | None = field(default_factory=lambda: list(C.DEFAULT_INCLUDE))
    exclude: list[str] | None = field(default_factory=lambda: list(C.DEFAULT_EXCLUDE))
    enabled_groups: list[str] | None = None
    disabled_rule_ids: list[str] | None = None
    fail_on: str | None = None
    marker: str = C.IGNORE_MARKER
    max_files: int | None = None
    """How many files go to discovery."""
    mode: str = "targeted"
    radius: int = C.CONTEXT_RADIUS
    provider: str = "compatible"
    model: str | None = None
    redacted: bool = True
    concurrency: int | None = None
    """How many requests are asked side by side."""
    include_discovered: bool = False
    """Whether discovered findings can fail the gate."""

    def with_preset(self, name: str) -> ScanConfig:
        """Take threshold, groups and disabled rules from a preset."""
        preset = next((p for p in C.PRESETS if p["name"] == name), None)
        if preset is None:
            known = ", ".join(p["name"] for p in C.PRESETS)
            raise ValueError(f"unknown preset {name!r}; known: {known}")
        every = "*" in preset["enabled_groups"]
        return replace(
            self,
            fail_on=preset["fail_on"],
            enabled_groups=None if every else preset["enabled_groups"],
            disabled_rule_ids=preset["disabled_rule_ids"],
        )

    @classmethod
    def create(cls, preset: str | None = None, **overrides) -> ScanConfig:
        """Defaults, then the preset, then explicit settings, which replace what the preset set."""
        base = cls().with_preset(preset) if preset else cls()
        return replace(base, **overrides)

    def choose(self, rules: list[dict]) -> list[dict]:
        """The rules these settings keep."""
        groups, disabled = self.enabled_groups or [], self.disabled_rule_ids or []
        kept = [r for r in rules if not groups or r.get("group") in groups]
        return [r for r in kept if r["id"] not in disabled]
