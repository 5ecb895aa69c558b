"""Wording of common licences, section by section (fixed values, as published).

Every section is a template of its own: a file that carries one section of a
licence, such as its disclaimer alone, is found by it.
"""

from __future__ import annotations

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as "
        "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_GNU_WARRANTY = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
                 "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.")
_CREATIVE = "This work is licensed under a Creative Commons {0} {1} International License."

# fixed values: label, sections
SECTIONS: list[tuple[str, str]] = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
            "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
            "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
            "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
            "SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met:"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
            "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
            "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
            "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
            "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software."),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
             "alter it and redistribute it freely, subject to the following restrictions:"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If "
             "you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
             "required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
             "original software. This notice may not be removed or altered from any source distribution."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
              "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
              "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
              "whom the Software is furnished to do so, all subject to the following:"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
                  "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
                  "copyright interest in the software to the public domain."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
               "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
               "the specific language governing permissions and limitations under the License."),
    ("apache", "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to "
               "You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, "
               "prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such "
               "Derivative Works in Source or Object form."),
    ("apache", "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You "
               "a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) "
               "patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work"),
    ("apache", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without "
               "modifications, and in Source or Object form, provided that You meet the following conditions:"),
    ("gpl", "Licensed under the GNU General Public License version 3"),
    ("gpl", _GNU.format("General Public License", "2")), ("gpl", _GNU_WARRANTY.format("General Public License")),
    ("gpl", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most "
            "software and other practical works are designed to take away your freedom to share and change the works."),
    ("lgpl", _GNU.format("Lesser General Public License", "2.1")), ("lgpl", _GNU_WARRANTY.format("Lesser General Public License")),
    ("agpl", _GNU.format("Affero General Public License", "3")), ("agpl", _GNU_WARRANTY.format("Affero General Public License")),
    ("agpl", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically "
             "designed to ensure cooperation with the community in the case of network server software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which "
            "is available at"),
    ("epl", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, "
            "REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her "
            "rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed "
            "by law."),
    ("cc-by", _CREATIVE.format("Attribution", "4.0")), ("cc-by-sa", _CREATIVE.format("Attribution-ShareAlike", "4.0")),
    ("cc-by-nc", _CREATIVE.format("Attribution-NonCommercial", "4.0")), ("cc-by-nd", _CREATIVE.format("Attribution-NoDerivatives", "4.0")),
    ("cc-by-nc-sa", _CREATIVE.format("Attribution-NonCommercial-ShareAlike", "4.0")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"), ("cc-by", "Licensed under CC BY 4.0"), ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("artistic", "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright "
                 "Holder maintains some semblance of artistic control over the development of the package"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is "
              "allowed as long as the name is changed."),
]
