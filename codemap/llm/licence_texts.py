"""Public licence texts and one-line notices, by SPDX identifier. Long texts are files of ``licence_files``."""
from __future__ import annotations

import pkgutil
import re

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = f"""{_MIT_GRANT}

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_MIT_WARRANTY}"""
_MIT_0 = f"""{_MIT_GRANT.removesuffix(", subject to the following conditions:")}.

{_MIT_WARRANTY}"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

{_ISC_WARRANTY}"""
_0BSD = f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

{_ISC_WARRANTY}"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3RD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _forms(text: str, *titles: str) -> list[str]:
    """A text alone and under its titles."""
    return [text] + [f"{t}\n\n{text}" for t in titles]


_FSF_ADDRESS = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA")
_FSF_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
                  "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA")
_END = "END OF TERMS AND CONDITIONS"


def _file(name: str) -> list[str]:
    """The forms of a text of ``licence_files``: as it is, without what says how to apply it, and under the publisher's addresses."""
    text = pkgutil.get_data("codemap.llm", f"licence_files/{name}.txt").decode("utf-8")
    forms = [text]
    if _FSF_ADDRESS.search(text):
        forms += [_FSF_ADDRESS.sub(a, text) for a in _FSF_ADDRESSES]
    forms += [f[:f.index(_END) + len(_END)] for f in forms if _END in f]
    return list(dict.fromkeys(forms))


TEXTS: dict[str, list[str]] = {
    "MIT": _forms(_MIT, "MIT License", "The MIT License", "The MIT License (MIT)"),
    "MIT-0": _forms(_MIT_0, "MIT No Attribution"),
    "ISC": _forms(_ISC, "ISC License"),
    "0BSD": _forms(_0BSD, "Zero-Clause BSD", "BSD Zero Clause License"),
    "BSD-2-Clause": _forms(f"{_BSD_HEAD}\n\n{_BSD_TAIL}", "BSD 2-Clause License"),
    "BSD-3-Clause": _forms(f"{_BSD_HEAD}\n\n{_BSD_3RD}\n\n{_BSD_TAIL}", "BSD 3-Clause License") + _file("BSD-3-Clause"),
    "Zlib": _forms(_ZLIB, "zlib License"),
    "Unlicense": _forms(_UNLICENSE, "The Unlicense"),
    "Apache-2.0": _forms(_APACHE_NOTICE) + _file("Apache-2.0") + [_file("Apache-2.0")[0].split(_END)[0]],
    "CC0-1.0": _file("CC0-1.0") + [_file("CC0-1.0")[0].removeprefix("Creative Commons Legal Code")],
    **{name: _file(name) for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "GFDL-1.2", "GFDL-1.3", "MPL-1.1", "MPL-2.0", "Artistic-1.0-Perl",
                                      "BSL-1.0", "CC-BY-SA-4.0", "Unicode-3.0")},
}

_NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "MIT": ("MIT License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
}
#: Creative Commons licences are named without an article.
_CC = {f"CC-{kind}-{v}": (f"CC {kind} {v}",) for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") for v in ("3.0", "4.0")}
_STARTS = ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under", "This software is licensed under",
           "This file is licensed under", "This project is licensed under")
NOTICES: dict[str, list[str]] = {
    **{i: [f"{s} the {n}" for s in _STARTS for n in names] + [f"SPDX-License-Identifier: {i}"] for i, names in _NAMES.items()},
    **{i: [f"{s} {n}" for s in _STARTS for n in names] + [f"SPDX-License-Identifier: {i}"] for i, names in _CC.items()},
}
