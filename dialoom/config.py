"""Settings of the dataset pipeline, from keyword arguments or a JSON file with comments."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields

from . import schema

CONFIG_ENV = "DIALOOM_CONFIG"


@dataclass(frozen=True)
class Config:
    platform: str = "chat"
    language: str = "zh"
    include_type: tuple[str, ...] = ("text",)
    max_image_num: int = 2
    blocked_words: tuple[str, ...] = ()
    add_time: bool = False
    add_relation: bool = False
    single_combine_time_window: float = 2
    qa_match_time_window: float = 5
    combine_msg_max_length: int = 2048
    messages_max_length: int = 2048
    enable_clean: bool = False
    accept_score: int = 2
    clean_batch_size: int = 10
    telegram_my_id: str = ""
    system_prompt: str = ""
    scope: str = "chat"
    strict_types: bool = False  # rows of types that the vocabulary doesn't name are left out
    slices: int = 0  # slices of the order for long chats; 0: a chat is one task
    relations: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name, allowed in (("platform", ("chat", "telegram")), ("language", ("zh", "en")), ("scope", ("chat", "global"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {allowed}")
        if unknown := set(self.include_type) - {"text", "image", "sticker"}:
            raise ValueError(f"include_type: {sorted(unknown)}")
        if self.platform == "telegram" and not self.telegram_my_id:
            raise ValueError("telegram_my_id is needed for telegram exports")

    @property
    def vocabulary(self) -> str:
        """Type names follow the platform, not the language."""
        return "zh" if self.platform == "chat" else "en"

    def cut_types(self) -> list[str]:
        gone = set(schema.IMAGE_TYPES) if "image" in self.include_type else set()
        return [t for t in schema.CUT[self.vocabulary] if t not in gone]

    def skip_types(self) -> list[str]:
        gone = {"sticker"} if self.platform == "telegram" and "sticker" in self.include_type else set()
        return [t for t in schema.SKIP[self.vocabulary] if t not in gone]

    def known_types(self) -> list[str]:
        return [*schema.CUT[self.vocabulary], *schema.SKIP[self.vocabulary], *schema.TEXT_TYPES, *schema.IMAGE_TYPES]

    def dataset_name(self, name: str) -> str:
        return name + "-vl" if "image" in self.include_type else name


def load(path: str | None = None) -> Config:
    """Read make-dataset settings; unknown keys are refused."""
    with open(path or os.environ[CONFIG_ENV], encoding="utf-8") as f:
        text = f.read()
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    raw = json.loads(re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text))
    if unknown := set(raw) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
