"""Templates of common licences, as (licence, key words, text): one-line headers, header notices and full texts.

A text carries a template only if it has all of its key words, so licences that differ by a name or a version are told
apart by it. The long texts lie in license_texts/, one file each.
"""

from __future__ import annotations

from pathlib import Path

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to
deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ASF = """Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for
additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to
permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement,
including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all
derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def _gnu(what: str, kind: str, version: str, later: bool) -> str:
    tail = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"{what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation; {tail}."


def _gnu_end(what: str, kind: str) -> str:
    return f"{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the GNU {kind} along with this program. If not, see http://www.gnu.org/licenses/."


def _names() -> list[tuple[str, str, str]]:
    named = [("MIT", "mit", "MIT"), ("BSD", "bsd", "BSD"), ("BSD-2-Clause", "bsd 2 clause", "BSD 2-Clause"), ("BSD-3-Clause", "bsd 3 clause", "BSD 3-Clause"), ("ISC", "isc", "ISC"), ("Zlib", "zlib", "zlib")]
    named += [("Apache-2.0", "apache 2", "Apache"), ("MPL-2.0", "mozilla 2", "Mozilla Public"), ("BSL-1.0", "boost 1", "Boost Software")]
    version = {"Apache-2.0": ", Version 2.0", "MPL-2.0": ", version 2.0", "BSL-1.0": ", Version 1.0"}
    out = []
    for how in ("Licensed", "Released", "Distributed"):
        out += [(name, f"license {keys}", f"{how} under the {said} License{version.get(name, '')}.") for name, keys, said in named]
    for name, kind, keys, v in [("GPL-2.0", "", "", "2"), ("GPL-3.0", "", "", "3"), ("LGPL-2.1", "Lesser ", "lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "lesser ", "3"), ("AGPL-3.0", "Affero ", "affero ", "3")]:
        full = f"license gnu public {keys}{v.replace('.', ' ')}"
        out += [(name, full, f"Licensed under the GNU {kind}General Public License, version {v}."), (name, full, f"This file is licensed under the terms of the GNU {kind}General Public License v{v}.")]
    return out


def _notices() -> list[tuple[str, str, str]]:
    out = [
        ("MIT", "permission hereby granted charge sublicense", _MIT),
        ("MIT", "permission hereby granted charge sublicense", f"{_MIT}\n{_AS_IS}"),
        ("BSD-2-Clause", "redistribution source binary forms", f"{_BSD}\n{_BSD_END}"),
        ("BSD-3-Clause", "redistribution source binary forms endorse", f"{_BSD}\n{_BSD_3}\n{_BSD_END}"),
        ("ISC", "permission use copy modify fee hereby granted", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
        ("ISC", "permission use copy modify fee hereby granted", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
        ("0BSD", "permission use copy modify fee hereby granted", f"{_ISC}.\n{_ISC_END}"),
        ("Apache-2.0", "license apache 2 compliance", _APACHE),
        ("Apache-2.0", "license apache 2 compliance", f"{_APACHE}\n{_APACHE_END}"),
        ("Apache-2.0", "license apache 2 compliance", _ASF),
        ("Apache-2.0", "license apache 2 compliance", f"{_ASF}\n{_APACHE_END}"),
        ("Zlib", "permission altered misrepresented", _ZLIB),
        ("BSL-1.0", "permission hereby granted machine executable", f"{_BOOST}\n{_AS_IS}"),
        ("Unlicense", "unencumbered public domain", _UNLICENSE),
        ("MPL-2.0", "license mozilla 2 subject", _MPL),
    ]
    for name, kind, keys, v in [("GPL-2.0", "", "", "2"), ("GPL-3.0", "", "", "3"), ("LGPL-2.1", "Lesser ", "lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "lesser ", "3"), ("AGPL-3.0", "Affero ", "affero ", "3")]:
        what, full = ("This library" if "Lesser" in kind else "This program"), f"license gnu public {keys}{v.replace('.', ' ')} terms"
        for later in (False, True):
            grant = _gnu(what, f"{kind}General Public License", v, later)
            out += [(name, full, grant), (name, full, f"{grant}\n{_gnu_end(what, f'{kind}General Public License')}")]
    return out


#: Key words of the long texts; each starts with one of these names.
_LONG = {"Apache": "license apache contribution", "GPL": "license gnu general public program", "LGPL": "license gnu lesser library", "MPL": "license mozilla covered", "CC0": "license cc0 affirmer"}


def _long() -> list[tuple[str, str, str]]:
    return [(p.stem, _LONG[p.stem.split("-")[0]], p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def common() -> list[tuple[str, str, str]]:
    return [*_names(), *_notices(), *_long()]
