"""Settings of a run, from the environment or given."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass

from repolith.operators.tree import MOST_DEPTH

#: The variables that name models, the service and its key.
VARIABLES = {"main_model": "MAIN_MODEL", "cluster_model": "CLUSTER_MODEL", "fallback_model": "FALLBACK_MODEL_1", "base_url": "LLM_BASE_URL", "api_key": "LLM_API_KEY"}


@dataclass(frozen=True)
class Settings:
    repo_path: str
    docs_dir: str
    graph_dir: str
    main_model: str | None = None
    cluster_model: str | None = None
    fallback_model: str | None = None
    base_url: str | None = None
    api_key: str | None = None
    most_depth: int = MOST_DEPTH


def from_environment(repo_path: str, output_dir: str = "output", environment: Mapping[str, str] | None = None) -> Settings:
    """Documents go to a folder named after the repository, whose other characters than letters and digits become underscores.
    The model that clusters is the main one unless it is named."""
    env = os.environ if environment is None else environment
    found = {field: env.get(name) for field, name in VARIABLES.items()}
    found["cluster_model"] = found["cluster_model"] or found["main_model"]
    name = re.sub(r"[\W_]", "_", os.path.basename(os.path.normpath(repo_path)))
    return Settings(repo_path, os.path.join(output_dir, "docs", f"{name}-docs"), os.path.join(output_dir, "dependency_graphs"), **found)


def given(repo_path: str, output_dir: str, main_model: str, cluster_model: str, fallback_model: str | None = None, base_url: str | None = None, api_key: str | None = None) -> Settings:
    """Documents go to ``output_dir`` itself, tables below its ``temp``."""
    return Settings(repo_path, output_dir, os.path.join(output_dir, "temp", "dependency_graphs"), main_model, cluster_model, fallback_model, base_url, api_key)
