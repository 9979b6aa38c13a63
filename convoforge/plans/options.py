"""Export options, their defaults, and their reading from loosely typed input."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

CHOICES = {
    "user_content": ("clean_query", "raw_full"),
    "thinking": ("tagged", "strip", "verbatim"),
    "subagent_mode": ("inline", "drop", "separate"),
}


@dataclass(frozen=True)
class ExportOptions:
    sft_chatml: bool = True
    sft_sharegpt: bool = False
    cpt_jsonl: bool = False
    cpt_txt: bool = False
    include_tool_calls: bool = False
    user_content: str = "clean_query"
    thinking: str = "tagged"
    clean_assistant: bool = True
    final_response_only: bool = False
    subagent_mode: str = "inline"
    include_subagent_sessions: bool = False
    copy_media: bool = True
    inline_readable_attachments: bool = False
    min_turns: int = 1
    val_fraction: float = 0.0
    with_metadata: bool = True
    redact_secrets: bool = False
    max_record_chars: int = 100_000

    @property
    def with_subagents(self) -> bool:
        return self.include_subagent_sessions or self.subagent_mode == "separate"

    @property
    def inline(self) -> bool:
        return self.subagent_mode == "inline"


PRESETS = {
    "chat": ExportOptions(),
    "agentic": ExportOptions(include_tool_calls=True),
    "cpt": ExportOptions(sft_chatml=False, cpt_jsonl=True, cpt_txt=True, thinking="verbatim"),
    "all": ExportOptions(sft_sharegpt=True, cpt_jsonl=True, cpt_txt=True, include_tool_calls=True),
}


def from_mapping(given: dict[str, object], base: ExportOptions = ExportOptions()) -> ExportOptions:
    """Override ``base``; unknown names are ignored, and unknown choices or values of the wrong type leave the default."""
    out = {}
    for f in fields(ExportOptions):
        value, default = given.get(f.name), getattr(base, f.name)
        if value is None:
            continue
        if f.name in CHOICES:
            out[f.name] = value if value in CHOICES[f.name] else default
        elif isinstance(default, bool):
            out[f.name] = value if isinstance(value, bool) else default
        elif isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 0:
            out[f.name] = type(default)(value)
    return replace(base, **out)
