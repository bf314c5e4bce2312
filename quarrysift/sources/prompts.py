"""Prompt templates from files, on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping

from quarrysift.sources.files import Folder

#: Variables that name a template file in place of the default, in order.
SYSTEM_VARIABLES = ["SYSTEM_PROMPT_TEMPLATE"]
USER_VARIABLES = ["USER_PROMPT_TEMPLATE", "PROMPT_TEMPLATE"]


def _template(default: str, variables: list[str], environment: Mapping[str, str]) -> str:
    path = next((environment[v] for v in variables if environment.get(v)), default)
    folder, _, name = path.rpartition("/")
    return Folder(folder or ".").read(name).decode()


def load_prompts(system: str, user: str, environment: Mapping[str, str] | None = None) -> tuple[str, str]:
    """The system prompt, stripped, and the user template, as it is: from the files that the environment names, else the given
    ones. A path can be a URI; a file that doesn't exist is an error."""
    environment = os.environ if environment is None else environment
    return _template(system, SYSTEM_VARIABLES, environment).strip(), _template(user, USER_VARIABLES, environment)
