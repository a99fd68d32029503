"""License notices and grants as their stewards publish them, and the words of each that decide: fixed values."""

GNU_NOTICE = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software "
    "Foundation{3} either version {4} of the License, or (at your option) any later version."
)
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)

TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-header": GNU_NOTICE.format("program", ":", "General Public License", ",", "3"),
    "GPL-2.0-header": GNU_NOTICE.format("program", ";", "General Public License", ";", "2"),
    "LGPL-2.0-header": GNU_NOTICE.format("library", ";", "Library General Public License", ";", "2"),
    "LGPL-2.1-header": GNU_NOTICE.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0-header": GNU_NOTICE.format("program", ":", "Lesser General Public License", ",", "3"),
    "AGPL-3.0-header": GNU_NOTICE.format("program", ":", "Affero General Public License", ",", "3"),
    **{
        f"CC-{kind}-{version}": f"Licensed under CC {kind} {version}."
        for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
        for version in ("2.0", "2.5", "3.0", "4.0")
    },
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-clauses": BSD_CLAUSES,
    "BSD-2-Clause": BSD_CLAUSES + (
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
    ),
    "BSD-3-Clause": BSD_CLAUSES + (
        " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Reserved": "All rights reserved.",
}


def _gnu(kind: str, short: str, version: str) -> list[str]:
    return [rf"gnu ({kind}(general )?public license|{short})", version]


#: Words that a passage must have, whatever else may differ: names and versions, as patterns over lower-case words.
REQUIRED = {
    "Apache-2.0": ["apache", r"2(\.0)?"],
    "Apache-2.0-header": ["apache", r"2(\.0)?"],
    "MPL-2.0": ["mozilla", r"(v )?2(\.0)?"],
    "BSD-2-Clause": ["software is provided"],
    "BSD-3-Clause": ["endorse or promote"],
    "Unlicense": ["unencumbered", "public domain"],
    **{f"GPL-2.0{x}": _gnu("", "gpl", r"version 2(\.0)?") for x in ("", "-header")},
    **{f"GPL-3.0{x}": _gnu("", "gpl", r"version 3(\.0)?") for x in ("", "-header")},
    "LGPL-2.0-header": _gnu("library ", "lgpl", r"version 2(\.0)?"),
    **{f"LGPL-2.1{x}": _gnu("lesser ", "lgpl", r"version 2\.1") for x in ("", "-header")},
    **{f"LGPL-3.0{x}": _gnu("lesser ", "lgpl", r"version 3(\.0)?") for x in ("", "-header")},
    **{f"AGPL-3.0{x}": _gnu("affero ", "agpl", r"version 3(\.0)?") for x in ("", "-header")},
}
