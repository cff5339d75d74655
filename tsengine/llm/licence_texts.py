"""Opening and notice paragraphs of widespread licences, by family; public texts, each line a paragraph to learn from."""

TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is distributed under the 3-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "MPL-2.0": [
        "Released under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "This document is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: SPDX identifiers of the families.
IDENTIFIERS: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT-0"],
    "Apache-2.0": ["Apache-2.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "0BSD"],
    "GPL": [f"GPL-{v}{s}" for v in ("2.0", "3.0") for s in ("", "-only", "-or-later")],
    "LGPL": [f"LGPL-{v}{s}" for v in ("2.0", "2.1", "3.0") for s in ("", "-only", "-or-later")],
    "AGPL": [f"AGPL-3.0{s}" for s in ("", "-only", "-or-later")],
    "MPL-2.0": ["MPL-2.0"],
    "ISC": ["ISC"],
    "Unlicense": ["Unlicense"],
    "CC0": ["CC0-1.0"],
    "CC-BY": ["CC-BY-3.0", "CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-3.0", "CC-BY-NC-4.0"],
    "proprietary": ["LicenseRef-Proprietary"],
}
#: Names that stand as headings, and other short notices.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT licensed"],
    "Apache-2.0": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "BSD": ["BSD License", "The BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License"],
    "GPL": ["GPL", "GNU GPL", "GPLv2", "GPLv3", "GNU GPLv3", "GNU General Public License", *(f"GNU General Public License{s}" for s in (", version 2", ", version 3", " v2.0", " v3.0"))],
    "LGPL": ["LGPL", "GNU LGPL", "LGPLv3", "GNU Lesser General Public License", *(f"GNU Lesser General Public License{s}" for s in (", version 2.1", ", version 3", " v2.1", " v3.0"))],
    "AGPL": ["AGPL", "GNU AGPL", "AGPLv3", "GNU Affero General Public License", *(f"GNU Affero General Public License{s}" for s in (", version 3", " v3.0"))],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "Unlicense": ["The Unlicense"],
    "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"],
    "CC-BY": ["CC BY", "CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "proprietary": ["All rights reserved.", "Proprietary and confidential.", "Proprietary license"],
}
#: Notices too short for shares of word pairs: a paragraph is one of them if it has the same words.
NOTICES = {f: [*NAMES[f], *(p + i for i in IDENTIFIERS[f] for p in ("SPDX-License-Identifier: ", "License: "))] for f in TEMPLATES}
#: Paragraphs that speak of licences, or like them, but grant none.
UNKNOWN = [
    "The driver must carry a valid license and the registration of the vehicle.",
    "Licensed premises may not serve guests after midnight.",
    "The version of the software was released last year under a new name.",
    "The public works department issued a general notice to the residents.",
    "The university of California has a large campus.",
    "A copy of the letter was distributed to all members of the foundation.",
    "The terms of the agreement were published in the local paper.",
    "Any person may attend the meeting free of charge.",
    "He obtained permission to use the hall for any purpose.",
    "The creative work of the commons committee was praised.",
    "See the file for the following list.",
    "Rights and permissions of the visitors are described below.",
]
