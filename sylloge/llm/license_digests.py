"""SHA-256 digests of the canonical forms of public licences and licence notices, with SPDX identifiers."""

DIGESTS: dict[str, str] = {
    "298fe79cf4d1301939a2679035830a3d78e85e27a3c9f491aee4fbeeb42238cd": "Apache-2.0",
    "54df39d73f3aaeb0325a6996fea0308bb0ed1cda5d3e88684094de1cf11b0c49": "Apache-2.0",
    "55c4818fec5edc4ad97ce6b966a9f3923e8e7dc48643b5d6333ba9a3b1d7e260": "Apache-2.0",
    "61e37e83588ce2698527a7d21a3b9b4762a937822ba108a58a8a002d8087ec03": "Apache-2.0",
    "629e3e0c6dd61e3670804dfe86ec068ebad38e602400cf9a37101e7d11247b85": "Apache-2.0",
    "86241aabd9a92d8c67dfd16d0ca22e43539f0d016601145785ab27ae4033cc00": "Apache-2.0",
    "8e4ff0b88442a2b67fc201f9b3ea9f698a4d26f8f83468ead1f50e875acd2bf3": "Apache-2.0",
    "a137d44e54c78ca1413757688a04f9e8db9bfcae315c66e30e9a6eca5bf3f90a": "Apache-2.0",
    "ed3239740bd9909fc793f5a6fef3dd0e0de0529ff728d06aa7337d387a0d6bf5": "Apache-2.0",
    "eff9e05c9de2ebaf67a47336fef7135676ea38a388048f3f843195d9ee4d2e77": "Apache-2.0",
    "e6e0a89c729d8b6f73de6a0422b960ddab89445ac9ad91383c9feda4dd0e3315": "Artistic-1.0-Perl",
    "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2": "BSD-2-Clause",
    "89ca91930ea55aff34ba4afee0eaa74b51a1b961b85435e5e171c210eeda6c49": "BSD-2-Clause",
    "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74": "BSD-2-Clause",
    "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30": "BSD-2-Clause",
    "0277adde5cc29f7069cc48741682fce0bce1b9465ea076766b9658e8022f3ae2": "BSD-3-Clause",
    "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651": "BSD-3-Clause",
    "4af76f6b1905a1186b51e0941ebeff988b0a3e53ec61a8b9d91a93a67097e825": "BSD-3-Clause",
    "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2": "BSD-3-Clause",
    "c165caf2263156afde96f4b02327c2ba96c47bd8cff887df37a4210399885793": "BSD-3-Clause",
    "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15": "BSD-3-Clause",
    "52ac4ad8b7fca6357364ff029f6cc509f1b89a9df281a190c894e77b798538e3": "CC-BY-3.0",
    "6a4aefd61c4a708d4e43bd59bbc9a4962debe7854a062fdd3a4fac4c52b433e5": "CC-BY-3.0",
    "d209ee2487d4fda51edabead61a79e4207f6b78afae65ca4942740ea02df2ad2": "CC-BY-3.0",
    "3b8fab3911ebb6c44af0dc74eb9b61a55e76f15a69fdeba891a997639d84e2ba": "CC-BY-4.0",
    "ad55ffff6ca3968fda2a3efa527dd68b5c4097e210449e4811c9fa29e916dbbd": "CC-BY-4.0",
    "f858c8cb335b5d6a503510f49161f882e8b89fd6b588904613abbfef7bd00058": "CC-BY-4.0",
    "2cd2e8d17c5602000dd9ce7230618739efc72e3010a357b7a22bd3e252c18d7b": "CC-BY-NC-3.0",
    "b65462ae1ffffd643da388b11ee31796b9f6adb2708e97fdb1f617ec1d43fb17": "CC-BY-NC-3.0",
    "c2a069a11fbdb76e333969a12864082da53d066459306cceb768a22068c3333a": "CC-BY-NC-3.0",
    "1129f21a75a139e856d06372121a5dbe596566548914419c4a2e4cbbed685657": "CC-BY-NC-4.0",
    "2e78ab9360304d5b2e1045aaecbdf5dc97ed56a2fd8039ed720a49e4ac15bfdb": "CC-BY-NC-4.0",
    "fd08a08951c154694108bfc37cf37fda942d3c51996dbcd3379b056038383787": "CC-BY-NC-4.0",
    "1f0008b6a00456decd9b3471428df69da2e781adc931736b5ae7177fa1cabec8": "CC-BY-NC-ND-4.0",
    "28a3ca38ba565ccfe6da78e28e2e67c619269a9265b2f20be3c44340698a2f46": "CC-BY-NC-ND-4.0",
    "79aedcd6eb4e364e629f6dd43af9e36096f46227368f9ef1ac8ed771d4db756c": "CC-BY-NC-ND-4.0",
    "0ed93a166a5db2f92b372ac3a4da05abffdb4276f0b09dcfd8d3f1d3b5373f5b": "CC-BY-NC-SA-4.0",
    "374b143258d69a1adb3c9f77cec4482135c2af367c01d782b87e6a7077fba825": "CC-BY-NC-SA-4.0",
    "a71228c7fc2e668341f3527bd99fc997bf819bc057daa1eeba8dac02af2e8f84": "CC-BY-NC-SA-4.0",
    "5850075fb40450d2bc61f5279234be8ce65d346973f366df19a41f1ce55594ed": "CC-BY-ND-4.0",
    "d24391b45387a138bd1a25f3e4c1356581308fb76900264053af511c1e148749": "CC-BY-ND-4.0",
    "edeecb27d0acffef35a89b3cd30b1c283d2456ab4c762594733ddcd15d6add12": "CC-BY-ND-4.0",
    "18bb9237447bf74c5f4e09934e7a2ce48ccf4e49a448eee331936d1896f574ff": "CC-BY-SA-3.0",
    "6f2202a8fec722b52535986bacf540bfed1d4c68aa99fc6ac538970608a402ab": "CC-BY-SA-3.0",
    "aa751f38b09e0105cce182f1d1e846ec9ebd4326ca0748497e67d372421a3366": "CC-BY-SA-3.0",
    "047cc44986b852734b1d823e65c1d04e9255172c533d1b225fa84b45132a2f83": "CC-BY-SA-4.0",
    "97a71a9694f66cb1c9e41bc579b210a75f7967b3220db9c9a5f1b0a21ae07d89": "CC-BY-SA-4.0",
    "f3d3c7d830563272cb5aee52bd7b52e6932ea9ed9de229fd3b3a8390f2461880": "CC-BY-SA-4.0",
    "1bc07ffacd061ab755e0461854b2e964c076d04d0c6b2335472fe319107eb2f6": "CC0-1.0",
    "96915353d7a84082bcbf6b803c99c651e279a832da34fbea4ba84c9005155395": "CC0-1.0",
    "9c110c8499fdce7c227d2ccbcca56e69c555a5c1cd8f55a2735e5fd1bb61ebc5": "GFDL-1.2",
    "58647d7698e8cc9287ab9cbe3caa6b96e7a4fdbc96758e88214e2e5eecbb2c9b": "GFDL-1.3",
    "4604f34ffdebeed249cceddb21baee83738cf6d6b94d7ae47484293bec1df829": "GPL-1.0",
    "0e6b0d8ae1640cddb38957b1a08b80e984c3f0eb62267c6ca3442ac53a559235": "GPL-2.0",
    "153618ed3dab8f1ab81a91a4d1cba353d09b9608bb938389593b0aef7d6c6322": "GPL-2.0",
    "28958fac8a58ce674ecb6977b393ca62e80e13a0c4832ec07c34de6da4d40e53": "GPL-2.0",
    "ee767ef3a599b72320b8b8b2bc3668ad48821d4c817f69d9335b81ce11cfe787": "GPL-2.0-or-later",
    "3101c5ffaa8af2f8de8cee2ba2c5b0c0558c08a3d24dafc1feae1dc583819bfb": "GPL-3.0",
    "345ddc417eed2da58a6a22674107901717852856fb9c1a538a66cc46ad05dc2a": "GPL-3.0",
    "82a400c7cc085b163cc6a097e72a15d0458553fcbf4344d003f6e5c7c0c6a56e": "GPL-3.0",
    "86cc14fde51d648e1d084ecc39341eefd11fedf263aba490c5b70924ca271986": "GPL-3.0",
    "dd6c151ebade1b5768bee74f68f3c2411f5642233b989d6264ff23749e134926": "GPL-3.0",
    "3f5f817483efbffb26e869e09a7c038be5cfefaee344419606b463e6909d08da": "GPL-3.0-or-later",
    "adc57f08417ed17a8ab63cb2d6aa8a9d4a7ccc34008f14f335a1ec54b6800d95": "ISC",
    "5b9798f5bb361ceac63635d7f4233edb1424725202ff476008e4ba8e43ee508e": "LGPL-2.0",
    "14b88834985f12f356fa4059a9513e7c5930f5e7501f224f04b45a0f9d57c67c": "LGPL-2.1",
    "6b7235d3fb71e3e003c181b2c4040028d4a5fe17bb00b1f21e7bbf9582ca9de5": "LGPL-3.0",
    "0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c": "MIT",
    "10084909833061795d86abbc16c393b5af06624cbf691604b5eb6eafe7e764f2": "MIT",
    "123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940": "MIT",
    "35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164": "MIT",
    "38d0813832561cee4591fba438a7323914ca8d6097ef6ff9fdd553815587b21e": "MIT",
    "6574b7ebe0cb585e9b2f2c05d1e04a3181922d9bf36edf6c9f6a3cba7bac1564": "MIT",
    "6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127": "MIT",
    "8ce93b2245a9d1b80f7da16dedba558b4c72b80097e4a8509f7c57bd4a664117": "MIT",
    "bf637265454fa1bb19e93b82695ec6f4ef7cfe2a7c742cf53ab79facb4d91c0c": "MIT",
    "834c175da439d19de02e5394de2c4e4d0cc8f7753f5dbd221d0576f6bd5564df": "MPL-1.1",
    "8f348ef7479d6155e0c21a1174325143b8376f2d2e67184b5a315a15cdad68a8": "MPL-2.0",
    "9d299cc532b9868f3f8a9efd71918375cf44ec4a9d5a17b34c5d81da4f0b7096": "MPL-2.0",
    "af3c48290a89614e341f9781801d7d70f3609603b1cf45cbbb5617e6a78e01a3": "MPL-2.0",
    "bddd8aed1edc9be5be172453950c8927b19c1b62f9addfef88b5ee18b8511f46": "Unlicense",
}
