"""Whole texts of short public licences and the usual headers of long ones, by SPDX identifier."""

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
    "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
    "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
    "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: ",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. ",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. ",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. ",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
    "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
    "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
    "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
    "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
    "removed or altered from any source distribution."
)


def _bsd(clauses: int, numbered: bool) -> str:
    """The text with numbers or with bullets, which the canonical form leaves out."""
    items = [f"{n}. {x}" if numbered else x for n, x in enumerate(_BSD[1 : 1 + clauses], 1)]
    return "".join([_BSD[0], *items, _BSD[-1]])


_WHOLE = [
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), _GRANT),
    ("ISC", ("ISC License", "The ISC License"), _ISC),
    *[("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License"), _bsd(2, x)) for x in (True, False)],
    *[("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License"), _bsd(3, x)) for x in (True, False)],
    ("Zlib", ("zlib License", "The zlib/libpng License"), _ZLIB),
]

_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at"
)
_UNLESS = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General "
    "Public License as published by the Free Software Foundation, either version {version} of the License, or (at your "
    "option) any later version."
)
_HEADERS = [
    ("Apache-2.0", _APACHE),
    *[("Apache-2.0", f"{_APACHE} {at}://www.apache.org/licenses/LICENSE-2.0") for at in ("http", "https")],
    *[("Apache-2.0", f"{_APACHE} {at}://www.apache.org/licenses/LICENSE-2.0{_UNLESS}") for at in ("http", "https")],
    *[
        (name, _GNU.format(what=what, mark=":", kind=kind, version=version))
        for name, kind, version in [
            ("GPL-2.0-or-later", "", "2"), ("GPL-3.0-or-later", "", "3"), ("LGPL-2.1-or-later", "Lesser ", "2.1"),
            ("LGPL-3.0-or-later", "Lesser ", "3"), ("AGPL-3.0-or-later", "Affero ", "3"),
        ]
        for what in ("program", "library", "software")
    ],
    *[
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                    f"MPL was not distributed with this file, You can obtain one at {at}://mozilla.org/MPL/2.0/.")
        for at in ("http", "https")
    ],
]

TEXTS = [(name, f"{title} {text}".strip()) for name, titles, text in _WHOLE for title in ("", *titles)] + _HEADERS
