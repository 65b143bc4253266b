"""Labelled texts of the licence classifier: notices by family, names by which families are declared, and near misses."""

from __future__ import annotations

#: Notices and paragraphs of the licences' texts, by family.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM',
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted. Simplified BSD License"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "GPL-2.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. Dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
    "all-rights-reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Names of the licences, as short declarations write them.
DECLARED = {
    "Apache-2.0": ["Apache 2.0 license", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0", "Apache License v2"],
    "MIT": ["MIT License", "MIT licence", "MIT-licensed", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "3-clause BSD license", "BSD-style license"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3 license", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "GNU General Public License v3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "LGPL-2.1", "LGPL-3.0-or-later", "LGPL"],
    "AGPL-3.0": ["GNU Affero General Public License", "GNU AGPL v3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-or-later", "GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL-2.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0", "CC0 public domain dedication"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
    "all-rights-reserved": ["All rights reserved", "proprietary license"],
}
#: Sentences that declare a licence by its name, and sentences that name one without declaring it.
FRAMES = ["{}", "License: {}", "SPDX-License-Identifier: {}", "{} code", "The {} applies to these files.", "The code is available under the {}, see LICENSE.", "Published under a {} license", "We share the sources under {}.", "covered by the {}"]
FRAMES += [f"{it} {verb} under {the} {{}}." for it in ("This project is", "These files are", "It was", "This work is") for verb in ("licensed", "released", "distributed", "made available") for the in ("the", "the terms of the")]
DENIALS = ["How does the {} differ from others?", "Projects under the {} were compared in the survey.", "Nothing here is under the {}.", "The {} was discussed at length in the meeting."]
DENIALS += [f"{it} {no} {verb} under the {{}}." for it, no in (("This is", "not"), ("It is", "no longer"), ("The files are", "never"), ("It", "isn't"), ("The code was", "never"), ("They are", "not"), ("This", "cannot be")) for verb in ("licensed", "released", "distributed", "available")]
#: Texts about other matters whose words a licence also uses.
NEAR_MISSES = [
    "She got her driving licence at the age of eighteen.", "The license plate of the car was stolen.", "A licensed engineer must sign the plan.", "He studied physics at MIT and later at Stanford.",
    "MIT researchers published a study.", "The Apache helicopter landed at noon.", "The Apache people lived in the southwest.", "The Apache web server answers requests.", "GNU is a recursive acronym.",
    "The general public was invited to the hearing.", "Public libraries are free of charge to any person.", "Software engineers modify and copy files.", "BSD is a family of operating systems.",
    "The creative commons of the village are open to all.", "Attribution of the painting remains uncertain.", "Permission is required to enter the building.", "The warranty covers parts for two years.",
    "All rights and duties of members are listed below.", "The publisher sent a written answer.", "Mozilla makes a web browser.", "An eclipse of the sun was seen.", "The version of the story differs.",
    "The foundation published a report.", "Conditions in the north are harsh.", "The domain of the function is public knowledge.", "Version 2.0 of the program was released.", "Version 3 is out now.", "Terms and conditions apply.",
    "Copyright law changed in that year.", "The software is free.", "Any later version of the plan will be discussed.", "A list of conditions was read aloud.", "The license fee rose by 4.0 percent.",
]
