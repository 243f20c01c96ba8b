"""Wording of licenses, of the standard headers that put a file under one, and of notices, by SPDX identifier.

Short licenses stand here whole, without list numbers and names; long ones by their header and by the title and opening
of their text, and whole in the folder ``wording``. Fixed values.
"""

from importlib import resources

_ASIS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
    "specific prior written permission. "
)
_BSD_ASIS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies. "
_ISC_ASIS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
    "License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_ASIS = (
    ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_FREE = "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, "
_LATER = "either version {version} of the License, or (at your option) any later version."
_ONLY = "version {version} of the License."
_HOPE = (
    " This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(kind: str, version: str, dated: str, work: str = "program") -> tuple[str, ...]:
    """Headers, with and without their second paragraph, and the head of the license's text."""
    headers = [(_FREE + a + b).format(work=work, kind=kind, version=version) for a in (_LATER, _ONLY) for b in ("", _HOPE)]
    return *headers, f"GNU {kind}GENERAL PUBLIC LICENSE Version {version}, {dated} Free Software Foundation, Inc. {_VERBATIM}"


TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (f"{_MIT}{_MIT_NOTICE} {_ASIS}", _MIT + _MIT_NOTICE, _MIT),
    "MIT-0": (f"{_MIT}. {_ASIS}",),
    "BSD-2-Clause": (_BSD + _BSD_ASIS,),
    "BSD-3-Clause": (_BSD + _BSD_NAMES + _BSD_ASIS, _BSD + _BSD_NAMES),
    "ISC": (_ISC + _ISC_NOTICE + _ISC_ASIS, _ISC + _ISC_NOTICE),
    "0BSD": (f"{_ISC}. {_ISC_ASIS}",),
    "Apache-2.0": (_APACHE + _APACHE_ASIS, _APACHE, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    "GPL-2.0": _gnu("", "2", "June 1991"),
    "GPL-3.0": _gnu("", "3", "29 June 2007"),
    "LGPL-2.0": _gnu("Library ", "2", "June 1991", "library"),
    "LGPL-2.1": _gnu("Lesser ", "2.1", "February 1999", "library"),
    "LGPL-3.0": _gnu("Lesser ", "3", "29 June 2007", "library"),
    "AGPL-3.0": _gnu("Affero ", "3", "19 November 2007"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain "
        "one at http://mozilla.org/MPL/2.0/.",
        'Mozilla Public License Version 2.0 Definitions "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}

_WORKS = ("This work is licensed under the {}", "Licensed under the {}", "Released under the {}")
_CC = ("This work is licensed under a Creative Commons {long} {version} International License", "Licensed under CC {short} {version}", "This work is licensed under CC {short} {version}")


def _works(*names: str) -> tuple[str, ...]:
    return tuple(w.format(name) for name in names for w in _WORKS)


def _cc(short: str, long: str, version: str = "4.0") -> tuple[str, ...]:
    return tuple(w.format(short=short, long=long, version=version) for w in _CC)


def _gnu_works(kind: str, version: str) -> tuple[str, ...]:
    return _works(f"GNU {kind}General Public License, version {version}", f"GNU {kind}General Public License v{version}")


NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": _works("MIT License"),
    "Apache-2.0": _works("Apache License, Version 2.0"),
    "GPL-2.0": _gnu_works("", "2"),
    "GPL-3.0": _gnu_works("", "3"),
    "LGPL-2.1": _gnu_works("Lesser ", "2.1"),
    "LGPL-3.0": _gnu_works("Lesser ", "3"),
    "AGPL-3.0": _gnu_works("Affero ", "3"),
    "BSD-2-Clause": _works("BSD 2-Clause License"),
    "BSD-3-Clause": _works("BSD 3-Clause License"),
    "MPL-2.0": _works("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright", "Licensed under CC0 1.0 Universal"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
    "Proprietary": ("All rights reserved", "All rights reserved. No part of this work may be reproduced without permission"),
}


def whole_texts() -> dict[str, tuple[str, ...]]:
    """Long licenses, word for word; read where the plan is made."""
    folder = resources.files(__package__) / "wording"
    return {f.name.removesuffix(".txt"): (f.read_text(encoding="utf-8"),) for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
