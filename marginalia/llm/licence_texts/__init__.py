"""Licences as whole texts, the *.txt files beside this one, and as the headers and titles that files carry."""

from __future__ import annotations

from pathlib import Path

_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.",
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this {what}; if not, see <https://www.gnu.org/licenses/>.",
)


def _gnu(what: str, kind: str, version: str, date: str) -> list[str]:
    first, rest = (t.format(what=what, kind=kind, version=version) for t in _GNU)
    return [first, f"{first} {rest}", f"GNU {kind} Version {version}, {date}"]


def _cc(kind: str) -> list[str]:
    return [f"Creative Commons {kind} 4.0 International Public License", f"This work is licensed under the Creative Commons {kind} 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]


#: The first paragraph of a header, the whole header, and titles.
HEADERS = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The MIT License (MIT)",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "GPL-2.0": _gnu("program", "General Public License", "2", "June 1991"),
    "GPL-3.0": _gnu("program", "General Public License", "3", "29 June 2007"),
    "LGPL-2.1": _gnu("library", "Lesser General Public License", "2.1", "February 1999"),
    "LGPL-3.0": _gnu("library", "Lesser General Public License", "3", "29 June 2007"),
    "AGPL-3.0": [*_gnu("program", "Affero General Public License", "3", "19 November 2007"), "This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "CC-BY-4.0": _cc("Attribution"),
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial"),
}


def texts() -> dict[str, list[str]]:
    """Headers, titles and whole texts by name."""
    found = {n: list(t) for n, t in HEADERS.items()}
    for path in sorted(Path(__file__).parent.glob("*.txt")):
        found.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return found
