"""The prototypes of the public Unicode confusables data: of every decomposed character that has another one, as ICU 77.1 (the icu4j that Spark ships) gives them."""

from __future__ import annotations

# Character:prototype, in hexadecimal.
_TABLE = """
22:27,27 25:BA,2F,2080 30:4F 31:6C 49:6C 60:27 6D:72,6E 7C:6C A0:20 A2:63,338 A5:59,335 AD: AF:2C9 B4:27 B5:3BC B8:2C C6:41,45 D0:44,335 D7:78
D8:4F,338 E6:61,65 F0:2202,335 F8:6F,338 110:44,335 111:64,335 126:48,335 127:68,335 131:69 132:6C,4A 133:69,6A 13F:6C,B7 140:6C,B7 141:4C,338
142:6C,338 149:27,6E 152:4F,45 153:6F,65 166:54,335 167:74,335 17F:66 180:62,335 181:27,42 182:62,304 183:62,304 184:62 187:43,27 189:44,335 18A:27,44
18C:64,304 18D:67 191:46,326 192:66,326 193:47,27 196:6C 197:6C,335 198:4B,27 199:6B,314 19A:6C,335 19B:3BB,338 19D:4E,326 19E:6E,329 19F:4F,335
1A4:27,50 1A5:70,314 1A6:52 1A7:32 1AC:27,54 1AD:74,314 1AE:54,328 1B3:27,59 1B4:79,314 1B5:5A,335 1B6:7A,335 1B7:33 1BB:32,335 1BC:35 1BD:73 1BF:FE
1C0:6C 1C1:6C,6C 1C3:21 1C4:44,5A,30C 1C5:44,7A,30C 1C6:64,7A,30C 1C7:4C,4A 1C8:4C,6A 1C9:6C,6A 1CA:4E,4A 1CB:4E,6A 1CC:6E,6A 1E4:47,335 1E5:67,335
1F1:44,5A 1F2:44,7A 1F3:64,7A 21C:33 222:38 223:38 224:5A,326 225:7A,326 23C:63,338 23E:54,338 241:3F 244:55,335 246:45,338 247:65,338 248:4A,335
249:6A,335 24D:72,335 24E:59,335 24F:79,335 251:61 253:62,314 256:64,328 257:64,314 259:1DD 25A:1DD,2DE 25B:A793 260:67,314 261:67 263:79 266:68,314
268:69,335 269:69 26A:69 26B:6C,334 26D:6C,328 26E:6C,21D 26F:77 271:72,6E,326 273:6E,328 275:6F,335 276:6F,1D07 27C:72,329 27D:72,328 282:73,328
28B:75 28F:79 290:7A,328 292:21D 294:3F 2A0:71,314 2A3:64,7A 2A4:64,21D 2A5:64,291 2A6:74,73 2A7:74,283 2A8:74,255 2A9:66,14B 2AA:6C,73 2AB:6C,7A
2B3:18F4 2B9:27 2BA:27,27 2BB:27 2BC:27 2BD:27 2BE:27 2BF:559 2C2:3C 2C3:3E 2C4:5E 2C6:5E 2C8:27 2CA:27 2CB:27 2D0:3A 2D3:559 2D7:2D 2D8:2C7 2D9:971
2DA:B0 2DB:69 2DC:7E 2DD:27,27 2E1:18F3 2E2:18F5 2E4:2C1 2EE:27,27 2F4:27 2F6:27,27 2F8:3A 2FB:2EA 305:304 30C:306 30D:670 310:306,307 311:302 315:313
317:650 320:331 321:326 322:328 327:326 336:335 337:338 339:326 342:303 345:328 347:333 34F: 357:350 358:307 366:30A 36E:306 370:2C75 375:2CF 376:418
377:1D0E 37A:69 37B:254 37D:A73F 37F:4A 384:27 391:41 392:42 395:45 396:5A 397:48 398:4F,335 399:6C 39A:4B 39B:245 39C:4D 39D:4E 39F:4F 3A1:50 3A3:1A9
3A4:54 3A5:59 3A7:58 3B1:61 3B2:DF 3B3:79 3B4:1E9F 3B5:A793 3B7:6E,329 3B8:4F,335 3B9:69 3BA:138 3BD:76 3BF:6F 3C1:70 3C3:6F 3C4:1D1B 3C5:75 3C6:278
3D0:DF 3D1:4F,335 3D2:59 3D5:278 3D6:3C0 3DB:3C2 3DC:46 3E8:32 3E9:1A8 3F0:138 3F1:70 3F2:63 3F3:6A 3F4:4F,335 3F5:A793 3F7:DE 3F8:FE 3F9:43 3FA:4D
3FD:186 3FF:A73E 404:A792 405:53 406:6C 408:4A 410:41 411:62,304 412:42 413:393 415:45 417:33 41A:4B 41B:245 41C:4D 41D:48 41E:4F 41F:3A0 420:50
421:43 422:54 423:59 424:3A6 425:58 42B:62,6C 42C:62 42E:6C,4F 430:61 431:36 432:299 433:72 435:65 437:25C 438:1D0E 43A:138 43C:28D 43D:29C 43E:6F
43F:3C0 440:70 441:63 442:1D1B 443:79 444:278 445:78 44A:2C9,62 44B:185,69 44C:185 44F:1D19 454:A793 455:73 456:69 458:6A 45B:68,335 461:77 462:62,335
463:62,335 470:3A8 471:3C8 472:4F,335 473:6F,335 474:56 475:76 47C:460,486,487 47D:77,486,487 48A:418,326,300 48B:438,326,306 48C:62,335 48D:62,335
490:393,27 491:72,27 492:393,335 493:72,335 496:416,329 497:436,329 498:33,326 499:25C,326 49A:4B,329 49B:138,329 49E:4B,335 49F:138,335 4A2:48,329
4A3:29C,329 4AA:43,326 4AB:63,326 4AC:54,329 4AD:1D1B,329 4AE:59 4AF:79 4B0:59,335 4B1:79,335 4B2:58,329 4BB:68 4BD:65 4BE:4BC,328 4BF:65,328 4C0:6C
4C5:245,326 4C6:43B,326 4C7:48,326 4C8:29C,326 4C9:48,326 4CA:29C,326 4CB:4B6 4CC:4B7 4CD:4D,326 4CE:28D,326 4CF:69 4D4:41,45 4D5:61,65 4D8:18F
4D9:1DD 4E0:33 4E1:21D 4E8:4F,335 4E9:6F,335 501:64 50A:1F6 50C:47 50D:262 510:190 511:A793 51B:71 51C:57 51D:77 53B:12AE 544:1206 54A:1323 54C:1261
54D:55 54F:53 553:3A6 555:4F 55A:27 55D:27 561:77 563:71 566:71 56E:1E9F 570:68 575:237 578:6E 57A:270 57C:6E 57D:75 581:67 584:66 585:6F 587:565,582
589:3A 59C:301 59D:301 5A4:59A 5A8:599 5AD:596 5AE:598 5AF:30A 5B4:323 5B9:307 5BA:307 5C0:6C 5C1:307 5C2:307 5C3:3A 5C4:307 5C5:323 5D5:6C 5D8:76
5D9:27 5DF:6C 5E1:6F 5F0:6C,6C 5F1:6C,27 5F2:27,27 5F3:27 5F4:27,27 609:BA,2F,2080,2080 60A:BA,2F,2080,2080,2080 60D:2C 60F:639 618:301 619:313
61A:650 61C: 627:6C 62B:649,6DB 634:633,6DB 63D:649,302 63F:649,6DB 647:6F 64A:649 64B:30B 64E:301 64F:313 652:30A 653:303 656:329 657:312 658:306
659:304 65A:306 65B:302 65C:323 65D:314 65F:655 660:2E 661:6C 665:6F 667:56 668:245 66A:BA,2F,2080 66B:2C 66C:60C 66D:2A 66E:649 66F:6A1 672:6C,674
673:6C,655 675:6C,674 676:648,674 677:648,313,674 678:649,674 679:649,615 67E:649,6DB 681:62D,654 685:62D,6DB 688:62F,615 68B:68A,615 68E:62F,6DB
691:631,615 692:631,306 698:631,6DB 69E:635,6DB 69F:637,6DB 6A4:6A1,6DB 6A7:641 6A8:6A1,6DB 6A9:643 6AA:643 6AD:643,6DB 6B4:6AF,6DB 6B5:644,306
6B7:644,6DB 6BA:649 6BB:649,615 6BD:649,6DB 6BE:6F 6C1:6F 6C3:629 6C6:648,306 6C7:648,313 6C8:648,670 6C9:648,302 6CB:648,6DB 6CC:649 6CE:649,306
6D0:67B 6D1:649,6DB 6D2:649 6D4:2D 6D5:6F 6DF:30A 6E8:306,307 6EC:307 6EE:62F,302 6EF:631,302 6F0:2E 6F1:6C 6F2:662 6F3:663 6F4:664 6F5:6F 6F6:666
6F7:56 6F8:245 6F9:669 6FD:621,348 6FE:645,348 6FF:6F,302 701:2E 702:2E 703:3A 704:3A 740:307 741:307 742:73C 747:301 751:628,6DB 756:649,306 762:6AC
763:643,6DB 767:754 768:646,615 769:646,306 76C:631,654 771:697,615 772:62D,654 77E:633,302 7C0:4F 7CA:6C 7EB:304 7ED:307 7EE:302 7F3:308 7F4:27
7F5:27 7FA:5F 8A1:628,654 8A4:6A2,6DB 8A7:645,6DB 8A8:649,654 8A9:754 8AE:62F,324,323 8AF:635,324,323 8B0:6AF 8B1:648 8B2:632,302 8B6:628,6E2
8B7:649,6DB,6E2 8B9:631,306,307 8BA:649,306,307 8BB:6A1 8BC:6A1 8BD:649 8E5:64C 8E8:64C 8EA:307 8EB:308 8ED:323 8EE:324 8F0:30B 8F1:64C 8F2:64D
8F3:313 8F8:350 8F9:354 8FA:355 8FF:350 900:352 901:306,307 902:307 903:3A 904:905,946 906:905,93E 908:930,94D,907 90D:90F,945 90E:90F,946 910:90F,947
911:905,949 912:905,93E,946 913:905,93E,947 914:905,93E,948 93C:323 952:331 953:300 954:301 965:964,964 966:6F 967:669 97D:3F 981:306,307 986:985,9BE
9BC:323 9E0:98B,9C3 9E1:98B,9C3 9E6:4F 9EA:38 9ED:39 A02:307 A03:983 A06:A05,A3E A07:A72,A3F A08:A72,A40 A09:A73,A41 A0A:A73,A42 A0F:A72,A47
A10:A05,A48 A14:A05,A4C A3C:323 A4B:946 A4D:94D A66:6F A67:39 A6A:38 A81:306,307 A82:307 A83:3A A86:A85,ABE A8D:A85,AC5 A8F:A85,AC7 A90:A85,AC8
A91:A85,ABE,AC5 A93:A85,ABE,AC7 A94:A85,ABE,AC8 ABC:323 ABD:93D AC1:941 AC2:942 ACD:94D AE6:6F AE8:968 AE9:969 AEA:96A AEE:96E AF0:970 B01:306,307
B03:38 B06:B05,B3E B20:4F B3C:323 B66:4F B68:39 B82:30A B8A:B89,BB3 B9C:B90 BB0:B88 BBE:B88 BC8:BA9 BCD:307 BD7:BB3 BE6:6F BE7:B95 BE8:B89 BEA:B9A
BEB:B88,BC1 BEC:B9A,BC1 BED:B8E BEE:B85 BF0:BAF BF2:B9A,BC2 BF4:BAE,BC0 BF5:BF3 BF7:B8E,BB5 BF8:BB7 BFA:BA8,BC0 C00:306,307 C02:6F C03:983 C13:C12,C55
C14:C12,C4C C20:C30,5BC C22:C21,323 C25:C27,5BC C2D:C2C,323 C2E:C35,C41 C37:C35,323 C39:C35,C3E C42:C41,C3E C44:C43,C3E C60:C0B,C3E C61:C0C,C3E C66:6F
C81:306,307 C82:6F C83:983 C85:C05 C86:C06 C87:C07 C92:C12 C93:C12,C55 C94:C12,C4C C9C:C1C C9E:C1E CA3:C23 CAF:C2F CB1:C31 CB2:C32 CE1:C8C,CBE CE6:6F
CE7:C67 CE8:C68 CEF:C6F D01:306,307 D02:6F D03:983 D08:D07,D57 D09:B89 D0A:B89,D57 D0C:D28,D41 D10:D0E,D46 D13:D12,D3E D14:D12,D57 D19:D28,D41 D1C:B90
D20:6F D23:BA3 D31:D30 D34:BB4 D36:BB6 D3A:B9F,BBF D3F:BBF D40:BBF D42:D41 D43:D41 D48:D46,D46 D4E:971 D5A:D28,D4D,D2E D5F:6F,D30,6F D61:D1E D66:6F
D6A:D30,D4D D6B:D26,D4D,D30 D6C:D28,D4D,D28 D6D:39 D6E:D35,D4D,D30 D6F:D28,D4D D76:D39,D4D,D2E D79:D28,D41 D7B:D28,D4D D7C:D30,D4D D82:6F D83:983
DE9:DE8,DCF DEA:DA2 DEB:DAF DEF:DE8,DD3 E03:E02 E0B:E0A E0F:E0E E14:E04 E15:E04 E17:E11 E21:E06 E26:E20 E33:30A,E32 E41:E40,E40 E45:E32 E4D:30A E50:6F
E88:E08 E8D:E22 E9A:E1A E9B:E1B E9D:E1D E9E:E1E E9F:E1F EB3:30A,EB2 EB8:E38 EB9:E39 EC8:E48 EC9:E49 ECA:E4A ECB:E4B ECD:30A ED0:6F EDC:EAB,E99
EDD:EAB,EA1 F00:F68,F7C,F7E F02:F60,F74,F82,F7F F03:F60,F74,F82,F14 F0C:F0B F0E:F0D,F0D F1B:F1A,F1A F1E:F1D,F1D F1F:F1A,F1D F37:325 F6A:F62
F77:FB2,F71,F80 F79:FB3,F71,F80 FCE:F1D,F1A FD5:5350 FD6:534D 1000:1002,102C 1010:6F,102C 101D:6F 101F:1015,102C 1029:101E,103C
102A:101E,103C,1031,102C,103A 1036:30A 1038:983 1040:6F 104B:104A,104A 1065:1041 1066:1015,103E 106F:1015,102C,103E 1070:1003,103E 107E:107D,103E
1081:1002,103E 109E:1083,30A 10A0:A786 10E7:79 10F3:21D 10FF:6F 1101:1100,1100 1104:1103,1103 1108:1107,1107 110A:1109,1109 110D:110C,110C
1113:1102,1100 1114:1102,1102 1115:1102,1103 1116:1102,1107 1117:1103,1100 1118:1105,1102 1119:1105,1105 111A:1105,1112 111B:1105,110B 111C:1106,1107
111D:1106,110B 111E:1107,1100 111F:1107,1102 1120:1107,1103 1121:1107,1109 1122:1107,1109,1100 1123:1107,1109,1103 1124:1107,1109,1107
1125:1107,1109,1109 1126:1107,1109,110C 1127:1107,110C 1128:1107,110E 1129:1107,1110 112A:1107,1111 112B:1107,110B 112C:1107,1107,110B 112D:1109,1100
112E:1109,1102 112F:1109,1103 1130:1109,1105 1131:1109,1106 1132:1109,1107 1133:1109,1107,1100 1134:1109,1109,1109 1135:1109,110B 1136:1109,110C
1137:1109,110E 1138:1109,110F 1139:1109,1110 113A:1109,1111 113B:1105,1112 113D:113C,113C 113F:113E,113E 1141:110B,1100 1142:110B,1103 1143:110B,1106
1144:110B,1107 1145:110B,1109 1146:110B,1140 1147:110B,110B 1148:110B,110C 1149:110B,110E 114A:110B,1110 114B:110B,1111 114D:110C,110B 114F:114E,114E
1151:1150,1150 1152:110E,110F 1153:110E,1112 1156:1111,1107 1157:1111,110B 1158:1112,1112 115A:1100,1103 115B:1102,1109 115C:1102,110C 115D:1102,1112
115E:1103,1105 115F: 1160: 1162:1161,4E28 1164:1163,4E28 1166:1165,4E28 1168:1167,4E28 116A:1169,1161 116B:1169,1161,4E28 116C:1169,4E28
116F:116E,1165 1170:116E,1165,4E28 1171:116E,4E28 1173:30FC 1174:30FC,4E28 1175:4E28 1176:1161,1169 1177:1161,116E 1178:1163,1169 1179:1163,116D
117A:1165,1169 117B:1165,116E 117C:1165,30FC 117D:1167,1169 117E:1167,116E 117F:1169,1165 1180:1169,1165,4E28 1181:1169,1167,4E28 1182:1169,1169
1183:1169,116E 1184:116D,1163 1185:116D,1163,4E28 1186:116D,1163 1187:116D,1169 1188:116D,4E28 1189:116E,1161 118A:116E,1161,4E28 118B:116E,1165,30FC
118C:116E,1167,4E28 118D:116E,116E 118E:1172,1161 118F:1172,1165 1190:1172,1165,4E28 1191:1172,1167 1192:1172,1167,4E28 1193:1172,116E 1194:1172,4E28
1195:30FC,116E 1196:30FC,30FC 1197:30FC,4E28,116E 1198:4E28,1161 1199:4E28,1163 119A:4E28,1169 119B:4E28,116E 119C:4E28,30FC 119D:4E28,119E
119F:119E,1165 11A0:119E,116E 11A1:119E,4E28 11A2:119E,119E 11A3:1161,30FC 11A4:1163,116E 11A5:1167,1163 11A6:1169,1163 11A7:1169,1163,4E28 11A8:1100
11A9:1100,1100 11AA:1100,1109 11AB:1102 11AC:1102,110C 11AD:1102,1112 11AE:1103 11AF:1105 11B0:1105,1100 11B1:1105,1106 11B2:1105,1107 11B3:1105,1109
11B4:1105,1110 11B5:1105,1111 11B6:1105,1112 11B7:1106 11B8:1107 11B9:1107,1109 11BA:1109 11BB:1109,1109 11BC:110B 11BD:110C 11BE:110E 11BF:110F
11C0:1110 11C1:1111 11C2:1112 11C3:1100,1105 11C4:1100,1109,1100 11C5:1102,1100 11C6:1102,1103 11C7:1102,1109 11C8:1102,1140 11C9:1102,1110
11CA:1103,1100 11CB:1103,1105 11CC:1105,1100,1109 11CD:1105,1102 11CE:1105,1103 11CF:1105,1103,1112 11D0:1105,1105 11D1:1105,1106,1100
11D2:1105,1106,1109 11D3:1105,1107,1109 11D4:1105,1107,1112 11D5:1105,1107,110B 11D6:1105,1109,1109 11D7:1105,1140 11D8:1105,110F 11D9:1105,1159
11DA:1106,1100 11DB:1106,1105 11DC:1106,1107 11DD:1106,1109 11DE:1106,1109,1109 11DF:1106,1140 11E0:1106,110E 11E1:1106,1112 11E2:1106,110B
11E3:1107,1105 11E4:1107,1111 11E5:1107,1112 11E6:1107,110B 11E7:1109,1100 11E8:1109,1103 11E9:1109,1105 11EA:1109,1107 11EB:1140 11EC:110B,1100
11ED:110B,1100,1100 11EE:110B,110B 11EF:110B,110F 11F0:114C 11F1:110B,1109 11F2:110B,1140 11F3:1111,1107 11F4:1111,110B 11F5:1112,1102 11F6:1112,1105
11F7:1112,1106 11F8:1112,1107 11F9:1159 11FA:1100,1102 11FB:1100,1107 11FC:1100,110E 11FD:1100,110F 11FE:1100,1112 11FF:1102,1102 1200:55 1223:270
1240:3A6 1260:548 1294:571 12D0:4F 13A0:44 13A1:52 13A2:54 13A4:4F,27 13A5:69 13A8:2C75 13A9:59 13AA:41 13AB:4A 13AC:45 13AE:3F 13B0:2C75 13B1:393
13B3:57 13B7:4D 13BB:48 13BD:59 13BE:4F,335 13BF:1AB 13C0:47 13C2:68 13C3:5A 13C7:460 13CB:190 13CC:55,335 13CE:34 13CF:62 13D2:52 13D4:57 13D5:53
13D9:56 13DA:53 13DE:4C 13DF:43 13E2:50 13E6:4B 13E7:64 13EB:4F,335 13EE:36 13F0:DF 13F2:68,314 13F3:47 13F4:42 13FB:262 13FC:299 1400:3D 1403:394
140C:B7,1401 140D:1401,B7 140E:B7,394 140F:394,B7 1410:B7,1404 1411:1404,B7 1412:B7,1405 1413:1405,B7 1414:B7,1406 1415:1406,B7 1417:B7,140A
1418:140A,B7 1419:B7,140B 141A:140B,B7 1427:B7 142B:1401,1420 142C:394,1420 142D:1405,1420 142E:140A,1420 142F:56 1431:245 1433:3E 1437:B7,3E 1438:3C
143A:B7,56 143B:56,B7 143C:B7,245 143D:245,B7 143E:B7,1432 143F:1432,B7 1440:B7,3E 1441:3E,B7 1442:B7,1434 1443:1434,B7 1444:B7,3C 1445:3C,B7
1446:B7,1439 1447:1439,B7 144A:27 144C:55 144E:548 1454:B7,1450 1457:B7,55 1458:55,B7 1459:B7,548 145A:548,B7 145B:B7,144F 145C:144F,B7 145D:B7,1450
145E:1450,B7 145F:B7,1451 1460:1451,B7 1461:B7,1455 1462:1455,B7 1463:B7,1456 1464:1456,B7 1467:55,27 1468:548,27 1469:1450,27 146A:1455,27 146D:50
146F:64 1472:62 1473:62,307 1474:B7,146B 1475:146B,B7 1476:B7,50 1477:70,B7 1478:B7,146E 1479:146E,B7 147A:B7,64 147B:64,B7 147C:B7,1470 147D:1470,B7
147E:B7,62 147F:62,B7 1480:B7,62,307 1481:62,307,B7 1485:146B,27 1486:50,27 1487:64,27 1488:62,27 148D:4A 1492:B7,1489 1493:1489,B7 1494:B7,148B
1495:148B,B7 1496:B7,148C 1497:148C,B7 1498:B7,4A 1499:4A,B7 149A:B7,148E 149B:148E,B7 149C:B7,1490 149D:1490,B7 149E:B7,1491 149F:1491,B7 14A5:393
14AA:4C 14AC:B7,14A3 14AD:14A3,B7 14AE:B7,393 14AF:393,B7 14B0:B7,14A6 14B1:14A6,B7 14B2:B7,14A7 14B3:14A7,B7 14B4:B7,14A8 14B5:14A8,B7 14B6:B7,4C
14B7:6C,B7 14B8:B7,14AB 14B9:14AB,B7 14BF:32 14C9:B7,14C0 14CA:14C0,B7 14CB:B7,14C7 14CC:14C7,B7 14CD:B7,14C8 14CE:14C8,B7 14D1:1421 14DC:B7,14D3
14DD:14D3,B7 14DE:B7,14D5 14DF:14D5,B7 14E0:B7,14D6 14E1:14D6,B7 14E2:B7,14D7 14E3:14D7,B7 14E4:B7,14D8 14E5:14D8,B7 14E6:B7,14DA 14E7:14DA,B7
14E8:B7,14DB 14E9:14DB,B7 14F6:B7,14ED 14F7:14ED,B7 14F8:B7,14EF 14F9:14EF,B7 14FA:B7,14F0 14FB:14F0,B7 14FC:B7,14F1 14FD:14F1,B7 14FE:B7,14F2
14FF:14F2,B7 1500:B7,14F4 1501:14F4,B7 1502:B7,14F5 1503:14F5,B7 150C:150B,3C 150D:150B,1455 150E:150B,62 150F:150B,1490 1517:B7,1510 1518:1510,B7
1519:B7,1511 151A:1511,B7 151B:B7,1512 151C:1512,B7 151D:B7,1513 151E:1513,B7 151F:B7,1514 1520:1514,B7 1521:B7,1515 1522:1515,B7 1523:B7,1516
1524:1516,B7 152F:B7,34 1530:34,B7 1531:B7,1528 1532:1528,B7 1533:B7,1529 1534:1529,B7 1535:B7,152A 1536:152A,B7 1537:B7,152B 1538:152B,B7
1539:B7,152D 153A:152D,B7 153B:B7,152E 153C:152E,B7 1540:1429 1541:78 154E:B7,154C 154F:154C,B7 155B:B7,155A 155C:155A,B7 1568:B7,1567 1569:1567,B7
1577:1E9F 157C:48 157D:78 157E:1550,146C 157F:1550,50 1580:1550,146E 1581:1550,64 1582:1550,1470 1583:1550,62 1584:1550,62,307 1585:1550,1483 1587:52
158E:1595,148A 158F:1595,148B 1590:1595,148C 1591:1595,4A 1592:1595,148E 1593:1595,1490 1594:1595,1491 15AF:62 15B4:46 15B5:2132 15B7:A7FB 15C4:2C6F
15C5:41 15DE:44 15EA:44 15EF:460 15F0:4D 15F7:42 1602:1490 1603:1489 1604:14D3 1607:14DA 1622:1543 1623:1546 1624:154A 162E:1B1 162F:3A9 1634:1B1
1635:3A9 166D:58 166E:78 166F:1550,146B 1670:1595,1489 1671:1596,148B 1672:1596,148C 1673:1596,4A 1674:1596,148E 1675:1596,1490 1676:1596,1491
1677:15A7,B7 1678:15A8,B7 1679:15A9,B7 167A:15AA,B7 167B:15AB,B7 167C:15AC,B7 167D:15AD,B7 1680:20 16B2:3C 16B7:58 16C1:6C 16C2:16BD 16CC:27 16D5:4B
16D6:4D 16D8:3A8 16E1:16BC 16EB:B7 16EC:3A 16ED:2B 16F0:3A6 1734:1715 1735:2F 17A3:17A2 17B4: 17B5: 17B7:E34 17B8:E35 17B9:E36 17BA:E37 17C6:30A
17CB:E48 17D3:30A 17D4:E2F 17D5:E5A 17D9:E4F 17DA:E5B 1803:3A 1809:3A 180B: 180C: 180D: 180E: 180F: 1855:1835 1896:185C 18B3:B7,18B1 18B6:B7,18B4
18B9:B7,18B8 18C2:B7,18C0 18C6:B7,14C2 18C7:14C2,B7 18C8:B7,14C3 18C9:14C3,B7 18CA:B7,14C4 18CB:14C4,B7 18CC:B7,14C5 18CD:14C5,B7 18CE:B7,1543
18CF:B7,1546 18D0:B7,1547 18D1:B7,1548 18D2:B7,1549 18D3:B7,154B 18DB:18F5 18DC:18DF,141E 18DD:141E,18DF 18E0:1543,B7 18E3:155E,B7 18E4:1566,B7
18E5:156B,B7 18E8:1586,B7 18EA:1597,B7 18ED:460,B7 18F0:15F4,B7 18F2:161B,B7 19D0:199E 19D1:19B1 1A80:1A45 1A90:1A45 1AA9:1AA8,1AA8 1AAB:1AAA,1AA8
1AB4:6DB 1AB7:328 1B52:1B0D 1B53:1B11 1B58:1B28 1B5C:1B50 1B5F:1B5E,1B5E 1C3C:1C3B,1C3B 1C7F:1C7E,1C7E 1CD0:302 1CD2:304 1CD3:27,27 1CD5:32B 1CD8:32E
1CD9:32D 1CDA:30E 1CDC:329 1CDD:323 1CDE:324 1CED:316 1D04:63 1D08:25C 1D0B:138 1D0D:28D 1D0F:6F 1D10:254 1D11:6F 1D14:1DD,6F 1D1C:75 1D20:76 1D21:77
1D22:7A 1D24:1A8 1D26:72 1D27:28C 1D28:3C0 1D29:1D18 1D2B:43B 1D3E:18D6 1D52:BA 1D6B:75,65 1D6E:66,334 1D6F:72,6E,334 1D70:6E,334 1D72:72,334
1D73:27E,334 1D74:73,334 1D75:74,334 1D76:7A,334 1D78:1D34 1D7B:69,335 1D7C:69,335 1D7D:70,335 1D7E:75,335 1D7F:28A,335 1D83:67 1D8C:79 1D90:24B
1D9F:1D4B 1DA2:1D4D 1DBA:18D4 1DBB:1646 1DEE:2DEC 1E9A:61,309 1E9D:66 1E9E:DF 1EFF:79 1FBD:27 1FBF:27 1FC0:7E 1FFE:27 2002:20 2003:20 2004:20 2005:20
2006:20 2007:20 2008:20 2009:20 200A:20 200B: 200C: 200D: 200E: 200F: 2010:2D 2011:2D 2012:2D 2013:2D 2014:30FC 2015:30FC 2016:6C,6C 2018:27 2019:27
201A:2C 201B:27 201C:27,27 201D:27,27 201F:27,27 2022:B7 2024:2E 2025:2E,2E 2026:2E,2E,2E 2027:B7 2028:20 2029:20 202A: 202B: 202C: 202D: 202E:
202F:20 2030:BA,2F,2080,2080 2031:BA,2F,2080,2080,2080 2032:27 2033:27,27 2034:27,27,27 2035:27 2036:27,27 2037:27,27,27 2039:3C 203A:3E 203C:21,21
203E:2C9 2041:2F 2043:2D 2044:2F 2047:3F,3F 2048:3F,21 2049:21,3F 204E:2A 2052:BA,2F,2080 2053:7E 2057:27,27,27,27 205A:3A 205D:2D57 205E:2D42 205F:20
2060: 2061: 2062: 2063: 2064: 2066: 2067: 2068: 2069: 206A: 206B: 206C: 206D: 206E: 206F: 2070:BA 2079:A770 20A1:43,20EB 20A4:A3 20A5:72,6E,338
20A8:52,73 20A9:57,335 20AB:64,335,331 20AC:A792 20AD:4B,335 20AE:54,20EB 20B6:6C,74 20BD:554 20DB:6DB 2100:61,2F,63 2101:61,2F,73 2102:43 2103:B0,43
2105:63,2F,6F 2106:63,2F,75 2107:190 2108:42D 2109:B0,46 210A:67 210B:48 210C:48 210D:48 210E:68 210F:68,335 2110:6C 2111:6C 2112:4C 2113:6C 2115:4E
2116:4E,6F 2119:50 211A:51 211B:52 211C:52 211D:52 2121:54,45,4C 2124:5A 2127:1B1 2128:5A 2129:27F 212C:42 212D:43 212E:65 212F:65 2130:45 2131:46
2133:4D 2134:6F 2135:5D0 2136:5D1 2137:5D2 2138:5D3 2139:69 213B:46,41,58 213C:3C0 213D:79 213E:393 213F:3A0 2140:1A9 2141:A4E8 2142:A4F6 2143:16F00
2145:44 2146:64 2147:65 2148:69 2149:6A 2160:6C 2161:6C,6C 2162:6C,6C,6C 2163:6C,56 2164:56 2165:56,6C 2166:56,6C,6C 2167:56,6C,6C,6C 2168:6C,58
2169:58 216A:58,6C 216B:58,6C,6C 216C:4C 216D:43 216E:44 216F:4D 2170:69 2171:69,69 2172:69,69,69 2173:69,76 2174:76 2175:76,69 2176:76,69,69
2177:76,69,69,69 2178:69,78 2179:78 217A:78,69 217B:78,69,69 217C:6C 217D:63 217E:64 217F:72,6E 2183:186 2184:254 2191:16CF 2195:16E8 21B5:21B2
21BA:1F10E 21BE:16DA 21BF:16D0 2200:2C6F 2203:18E 2206:394 220F:3A0 2211:1A9 2212:2D 2214:2B,307 2215:2F 2216:5C 2217:2A 2218:B0 2219:B7 221E:6F,6F
2223:6C 2225:6C,6C 2228:76 2229:548 222A:55 222B:283 222C:283,283 222D:283,283,283 222F:222E,222E 2230:222E,222E,222E 2236:3A 2238:2D,307 223C:7E
2250:3D,307 2251:3D,323,307 2257:3D,30A 2259:3D,302 225A:3D,306 225E:3D,36B 2263:2261 226A:3C,3C 226B:3E,3E 2282:1455 2283:1450 2295:102A8 2296:4F,335
2299:298 229D:4F,335 22A4:54 22A5:A4D5 22C0:2227 22C1:76 22C2:548 22C3:55 22C4:16DC 22C5:B7 22C8:16DE 22D6:3C,B7 22D7:B7,3E 22D8:3C,3C,3C
22D9:3E,3E,3E 22EE:2D57 22EF:B7,B7,B7 22F4:A793 22FF:45 2300:2205 2325:2324 2341:303C 2359:394,332 235A:16DC,332 235C:B0,332 235F:229B 2361:54,308
2362:2207,308 2363:22C6,308 2364:B0,308 2365:629 2368:7E,308 2369:1435 236B:2207,334 236C:4F,335 2373:69 2374:70 2375:3C9 2376:61,332 2377:A793,332
2378:69,332 2379:3C9,332 237A:61 237F:16BD 239C:4E28 239F:4E28 23A2:4E28 23A5:4E28 23AA:4E28 23AE:4E28 23C1:2355 23C2:234E 23C3:234B 23C6:236D
23E8:2081,2080 23FC:23FB 23FD:6C 23FE:263E 244A:5C,5C 2460:2780 2461:2781 2462:2782 2463:2783 2464:2784 2465:2785 2466:2786 2467:2787 2468:2788
2469:2789 2474:28,6C,29 2475:28,32,29 2476:28,33,29 2477:28,34,29 2478:28,35,29 2479:28,36,29 247A:28,37,29 247B:28,38,29 247C:28,39,29
247D:28,6C,4F,29 247E:28,6C,6C,29 247F:28,6C,32,29 2480:28,6C,33,29 2481:28,6C,34,29 2482:28,6C,35,29 2483:28,6C,36,29 2484:28,6C,37,29
2485:28,6C,38,29 2486:28,6C,39,29 2487:28,32,4F,29 2488:6C,2E 2489:32,2E 248A:33,2E 248B:34,2E 248C:35,2E 248D:36,2E 248E:37,2E 248F:38,2E 2490:39,2E
2491:6C,4F,2E 2492:6C,6C,2E 2493:6C,32,2E 2494:6C,33,2E 2495:6C,34,2E 2496:6C,35,2E 2497:6C,36,2E 2498:6C,37,2E 2499:6C,38,2E 249A:6C,39,2E
249B:32,4F,2E 249C:28,61,29 249D:28,62,29 249E:28,63,29 249F:28,64,29 24A0:28,65,29 24A1:28,66,29 24A2:28,67,29 24A3:28,68,29 24A4:28,69,29
24A5:28,6A,29 24A6:28,6B,29 24A7:28,6C,29 24A8:28,72,6E,29 24A9:28,6E,29 24AA:28,6F,29 24AB:28,70,29 24AC:28,71,29 24AD:28,72,29 24AE:28,73,29
24AF:28,74,29 24B0:28,75,29 24B1:28,76,29 24B2:28,77,29 24B3:28,78,29 24B4:28,79,29 24B5:28,7A,29 24B8:A9 24C5:2117 24C7:AE 24DB:24BE 24EA:1F10D
2500:30FC 2501:30FC 2503:2502 250F:250C 2523:251C 2571:2F 2573:58 2588:220E 2590:258C 2594:2C9 2597:2596 259D:2598 25A0:220E 25B1:23E5 25B3:394
25B7:22B3 25B8:25B6 25BA:25B6 25BD:102BC 25C1:22B2 25C7:16DC 25CA:16DC 25CB:B0 25CE:233E 25E0:2312 25E6:B0 2609:298 2610:25A1 2625:1099E 2630:2CB6
2638:2388 264E:224F 2662:16DC 2669:1D158,1D165 266A:1D158,1D165,1D16E 26AC:970 2768:28 2769:29 276E:3C 276F:3E 2772:28 2773:29 2774:7B 2775:7D 2795:2B
2796:2D 2797:F7 27C2:A4D5 27C8:5C,1455 27C9:1450,2F 27CB:2F 27CD:5C 27D9:54 27E8:276C 27E9:276D 292B:78 292C:78 2963:16D0,16DA 2965:21C3,21C2
296E:16D0,21C2 296F:21C3,16DA 2999:2D42 29B0:2349 29BE:233E 29C4:303C 29C5:2342 29C7:233B 29D6:102C0 29D9:299A 29F4:3A,2192 29F5:5C 29F6:2F,304
29F8:2F 29F9:5C 2A00:298 2A01:102A8 2A02:2297 2A03:228D 2A04:228E 2A05:2293 2A06:2294 2A0C:283,283,283,283 2A1D:16DE 2A20:3E,3E 2A21:16DA 2A22:2B,30A
2A23:2B,302 2A24:2B,303 2A25:2B,323 2A26:2B,330 2A27:2B,2082 2A29:2D,313 2A2A:2D,323 2A2F:78 2A30:78,307 2A3D:2319 2A3E:2A1F 2A3F:2210 2A6A:7E,307
2A6E:3D,20F0 2A74:3A,3A,3D 2A75:3D,3D 2A76:3D,3D,3D 2AA5:3E,3C 2AAA:15D5 2AAB:15D2 2AD7:1450,1455 2AFB:2F,2F,2F 2AFD:2F,2F 2BEC:219E 2BED:219F
2BEE:21A0 2BEF:21A1 2C67:48,329 2C69:4B,329 2C84:393 2C85:72 2C86:394 2C88:A792 2C89:A793 2C8E:48 2C92:6C 2C94:4B 2C95:138 2C96:3BB 2C98:4D 2C9A:4E
2C9E:4F 2C9F:6F 2CA0:3A0 2CA2:50 2CA3:70 2CA4:43 2CA5:63 2CA6:54 2CA8:59 2CAA:3A6 2CAB:278 2CAC:58 2CAD:3C7 2CAE:3A8 2CB1:3C9 2CB4:3C,B7 2CBA:2D
2CBC:428 2CBD:448 2CC6:2F 2CCA:39 2CCC:33 2CCD:21D 2CD0:4C 2CD1:29F 2CD2:36 2CDC:3EC 2CE4:3D7 2CE9:2627 2CF9:5C,5C 2D31:4F,335 2D37:245 2D38:56
2D39:45 2D3A:18E 2D41:4F,338 2D48:B7,B7,B7 2D49:1A9 2D4F:6C 2D51:21 2D54:4F 2D55:51 2D59:298 2D5D:58 2D60:394 2D63:16EF 2DE8:1DDF 2DEA:30A 2DED:368
2DEF:36F 2DF6:363 2DF7:364 2E1A:2D,308 2E1E:7E,307 2E1F:7E,323 2E26:1455 2E27:1450 2E28:28,28 2E29:29,29 2E2A:2235 2E2B:2234 2E2C:2237 2E2E:61F
2E30:B0 2E31:B7 2E32:60C 2E35:61B 2E39:1E9F 2E3D:2D42 2E3F:B6 2E40:3D 2E82:4E5B 2E83:4E5A 2E85:4EBB 2E89:5202 2E8B:353E 2E8E:5140 2E8F:5C23 2E90:5C22
2E92:5DF3 2E93:5E7A 2E94:5F51 2E96:5FC4 2E97:38FA 2E98:624C 2E99:6535 2E9B:65E1 2E9E:6B7A 2E9F:6BCD 2EA0:6C11 2EA1:6C35 2EA2:6C3A 2EA3:706C 2EA4:722B
2EA6:4E2C 2EA8:72AD 2EAB:7F52 2EAD:793B 2EAF:7CF9 2EB1:7F53 2EB2:7F52 2EB9:8002 2EBA:8080 2EBE:8279 2EBF:8279 2EC0:8279 2EC1:864E 2EC2:8864 2EC3:8980
2EC4:897F 2EC5:89C1 2EC8:8BA0 2EC9:8D1D 2ECB:8F66 2ECC:8FB6 2ECD:8FB6 2ECF:961D 2ED0:9485 2ED1:9577 2ED2:9578 2ED3:957F 2ED4:95E8 2ED6:961D 2ED8:9752
2ED9:97E6 2EDA:9875 2EDB:98CE 2EDC:98DE 2EDD:98DF 2EDF:98E0 2EE0:9963 2EE2:9A6C 2EE4:9B3C 2EE5:9C7C 2EE8:9EA6 2EE9:9EC4 2EEB:6589 2EEC:9F50 2EED:6B6F
2EEE:9F7F 2EEF:7ADC 2EF0:9F99 2EF2:4E80 2EF3:9F9F 2F00:30FC 2F01:4E28 2F02:5C 2F03:2F 2F04:4E59 2F05:4E85 2F06:4E8C 2F07:4EA0 2F08:4EBA 2F09:513F
2F0A:5165 2F0B:516B 2F0C:5182 2F0D:5196 2F0E:51AB 2F0F:51E0 2F10:51F5 2F11:5200 2F12:529B 2F13:52F9 2F14:5315 2F15:531A 2F16:5338 2F17:5341 2F18:535C
2F19:5369 2F1A:5382 2F1B:53B6 2F1C:53C8 2F1D:53E3 2F1E:53E3 2F1F:571F 2F20:571F 2F21:5902 2F22:590A 2F23:5915 2F24:5927 2F25:5973 2F26:5B50 2F27:5B80
2F28:5BF8 2F29:5C0F 2F2A:5C22 2F2B:5C38 2F2C:5C6E 2F2D:5C71 2F2E:5DDB 2F2F:5DE5 2F30:5DF1 2F31:5DFE 2F32:5E72 2F33:5E7A 2F34:5E7F 2F35:5EF4 2F36:5EFE
2F37:5F0B 2F38:5F13 2F39:5F50 2F3A:5F61 2F3B:5F73 2F3C:5FC3 2F3D:6208 2F3E:6236 2F3F:624B 2F40:652F 2F41:6534 2F42:6587 2F43:6597 2F44:65A4 2F45:65B9
2F46:65E0 2F47:65E5 2F48:66F0 2F49:6708 2F4A:6728 2F4B:6B20 2F4C:6B62 2F4D:6B79 2F4E:6BB3 2F4F:6BCB 2F50:6BD4 2F51:6BDB 2F52:6C0F 2F53:6C14 2F54:6C34
2F55:706B 2F56:722A 2F57:7236 2F58:723B 2F59:723F 2F5A:7247 2F5B:7259 2F5C:725B 2F5D:72AC 2F5E:7384 2F5F:7389 2F60:74DC 2F61:74E6 2F62:7518 2F63:751F
2F64:7528 2F65:7530 2F66:758B 2F67:7592 2F68:7676 2F69:767D 2F6A:76AE 2F6B:76BF 2F6C:76EE 2F6D:77DB 2F6E:77E2 2F6F:77F3 2F70:793A 2F71:79B8 2F72:79BE
2F73:7A74 2F74:7ACB 2F75:7AF9 2F76:7C73 2F77:7CF8 2F78:7F36 2F79:7F51 2F7A:7F8A 2F7B:7FBD 2F7C:8001 2F7D:800C 2F7E:8012 2F7F:8033 2F80:807F 2F81:8089
2F82:81E3 2F83:81EA 2F84:81F3 2F85:81FC 2F86:820C 2F87:821B 2F88:821F 2F89:826E 2F8A:8272 2F8B:8278 2F8C:864D 2F8D:866B 2F8E:8840 2F8F:884C 2F90:8863
2F91:897E 2F92:898B 2F93:89D2 2F94:8A00 2F95:8C37 2F96:8C46 2F97:8C55 2F98:8C78 2F99:8C9D 2F9A:8D64 2F9B:8D70 2F9C:8DB3 2F9D:8EAB 2F9E:8ECA 2F9F:8F9B
2FA0:8FB0 2FA1:8FB5 2FA2:9091 2FA3:9149 2FA4:91C6 2FA5:91CC 2FA6:91D1 2FA7:9577 2FA8:9580 2FA9:961C 2FAA:96B6 2FAB:96B9 2FAC:96E8 2FAD:9751 2FAE:975E
2FAF:9762 2FB0:9769 2FB1:97CB 2FB2:97ED 2FB3:97F3 2FB4:9801 2FB5:98A8 2FB6:98DB 2FB7:98DF 2FB8:9996 2FB9:9999 2FBA:99AC 2FBB:9AA8 2FBC:9AD8 2FBD:9ADF
2FBE:9B25 2FBF:9B2F 2FC0:9B32 2FC1:9B3C 2FC2:9B5A 2FC3:9CE5 2FC4:9E75 2FC5:9E7F 2FC6:9EA5 2FC7:9EBB 2FC8:9EC3 2FC9:9ECD 2FCA:9ED1 2FCB:9EF9 2FCC:9EFD
2FCD:9F0E 2FCE:9F13 2FCF:9F20 2FD0:9F3B 2FD1:9F4A 2FD2:9F52 2FD3:9F8D 2FD4:9F9C 2FD5:9FA0 3002:2F3 3003:27,27 3007:4F 3008:276C 3009:276D 3012:20B8
3014:28 3015:29 301A:27E6 301B:27E7 302C:309 302D:325 3033:2F 3036:20B8 3038:5341 3039:5344 303A:5345 304F:276C 309A:30A 309B:FF9E 309C:FF9F 30A0:3D
30A4:4EBB 30A8:5DE5 30AB:529B 30BF:5915 30C8:535C 30CB:4E8C 30CE:2F 30CF:516B 30D8:3078 30ED:53E3 30FB:B7 3126:513F 3131:1100 3132:1100,1100
3133:1100,1109 3134:1102 3135:1102,110C 3136:1102,1112 3137:1103 3138:1103,1103 3139:1105 313A:1105,1100 313B:1105,1106 313C:1105,1107 313D:1105,1109
313E:1105,1110 313F:1105,1111 3140:1105,1112 3141:1106 3142:1107 3143:1107,1107 3144:1107,1109 3145:1109 3146:1109,1109 3147:110B 3148:110C
3149:110C,110C 314A:110E 314B:110F 314C:1110 314D:1111 314E:1112 314F:1161 3150:1161,4E28 3151:1163 3152:1163,4E28 3153:1165 3154:1165,4E28 3155:1167
3156:1167,4E28 3157:1169 3158:1169,1161 3159:1169,1161,4E28 315A:1169,4E28 315B:116D 315C:116E 315D:116E,1165 315E:116E,1165,4E28 315F:116E,4E28
3160:1172 3161:30FC 3162:30FC,4E28 3163:4E28 3164: 3165:1102,1102 3166:1102,1103 3167:1102,1109 3168:1102,1140 3169:1105,1100,1109 316A:1105,1103
316B:1105,1107,1109 316C:1105,1140 316D:1105,1159 316E:1106,1107 316F:1106,1109 3170:1106,1140 3171:1106,110B 3172:1107,1100 3173:1107,1103
3174:1107,1109,1100 3175:1107,1109,1103 3176:1107,110C 3177:1107,1110 3178:1107,110B 3179:1107,1107,110B 317A:1109,1100 317B:1109,1102 317C:1109,1103
317D:1109,1107 317E:1109,110C 317F:1140 3180:110B,110B 3181:114C 3182:110B,1109 3183:110B,1140 3184:1111,110B 3185:1112,1112 3186:1159 3187:116D,1163
3188:116D,1163,4E28 3189:116D,4E28 318A:1172,1167 318B:1172,1167,4E28 318C:1172,4E28 318D:119E 318E:119E,4E28 31D0:30FC 31D1:4E28 31D3:2F 31D4:5C
31D6:4E5B 31DA:4E85 31DB:276C 31DF:4E5A 31E0:4E59 3200:28,1100,29 3201:28,1102,29 3202:28,1103,29 3203:28,1105,29 3204:28,1106,29 3205:28,1107,29
3206:28,1109,29 3207:28,110B,29 3208:28,110C,29 3209:28,110E,29 320A:28,110F,29 320B:28,1110,29 320C:28,1111,29 320D:28,1112,29 320E:28,1100,1161,29
320F:28,1102,1161,29 3210:28,1103,1161,29 3211:28,1105,1161,29 3212:28,1106,1161,29 3213:28,1107,1161,29 3214:28,1109,1161,29 3215:28,110B,1161,29
3216:28,110C,1161,29 3217:28,110E,1161,29 3218:28,110F,1161,29 3219:28,1110,1161,29 321A:28,1111,1161,29 321B:28,1112,1161,29 321C:28,110C,116E,29
321D:28,110B,1169,110C,1165,11AB,29 321E:28,110B,1169,1112,116E,29 3220:28,30FC,29 3221:28,4E8C,29 3222:28,4E09,29 3223:28,56DB,29 3224:28,4E94,29
3225:28,516D,29 3226:28,4E03,29 3227:28,516B,29 3228:28,4E5D,29 3229:28,5341,29 322A:28,6708,29 322B:28,706B,29 322C:28,6C34,29 322D:28,6728,29
322E:28,91D1,29 322F:28,571F,29 3230:28,65E5,29 3231:28,682A,29 3232:28,6709,29 3233:28,793E,29 3234:28,540D,29 3235:28,7279,29 3236:28,8CA1,29
3237:28,795D,29 3238:28,52B4,29 3239:28,4EE3,29 323A:28,547C,29 323B:28,5B66,29 323C:28,76E3,29 323D:28,4F01,29 323E:28,8CC7,29 323F:28,5354,29
3240:28,796D,29 3241:28,4F11,29 3242:28,81EA,29 3243:28,81F3,29 32C0:6C,6708 32C1:32,6708 32C2:33,6708 32C3:34,6708 32C4:35,6708 32C5:36,6708
32C6:37,6708 32C7:38,6708 32C8:39,6708 32C9:6C,4F,6708 32CA:6C,6C,6708 32CB:6C,32,6708 3358:4F,70B9 3359:6C,70B9 335A:32,70B9 335B:33,70B9
335C:34,70B9 335D:35,70B9 335E:36,70B9 335F:37,70B9 3360:38,70B9 3361:39,70B9 3362:6C,4F,70B9 3363:6C,6C,70B9 3364:6C,32,70B9 3365:6C,33,70B9
3366:6C,34,70B9 3367:6C,35,70B9 3368:6C,36,70B9 3369:6C,37,70B9 336A:6C,38,70B9 336B:6C,39,70B9 336C:32,4F,70B9 336D:32,6C,70B9 336E:32,32,70B9
336F:32,33,70B9 3370:32,34,70B9 33E0:6C,65E5 33E1:32,65E5 33E2:33,65E5 33E3:34,65E5 33E4:35,65E5 33E5:36,65E5 33E6:37,65E5 33E7:38,65E5 33E8:39,65E5
33E9:6C,4F,65E5 33EA:6C,6C,65E5 33EB:6C,32,65E5 33EC:6C,33,65E5 33ED:6C,34,65E5 33EE:6C,35,65E5 33EF:6C,36,65E5 33F0:6C,37,65E5 33F1:6C,38,65E5
33F2:6C,39,65E5 33F3:32,4F,65E5 33F4:32,6C,65E5 33F5:32,32,65E5 33F6:32,33,65E5 33F7:32,34,65E5 33F8:32,35,65E5 33F9:32,36,65E5 33FA:32,37,65E5
33FB:32,38,65E5 33FC:32,39,65E5 33FD:33,4F,65E5 33FE:33,6C,65E5 39B3:363D 439B:3588 4420:3B3B 4E00:30FC 4E36:5C 4E3F:2F 5002:4F75 503C:5024 555F:5553
56D7:53E3 586B:5861 58EB:571F 58FF:58AB 5B00:5AAF 5E32:5E21 5E50:3B3A 6238:6236 6409:3A41 6663:403F 6669:665A 66F6:3ADA 6726:4443 67FF:676E 69E9:3BA3
6A27:699D 6F59:6E88 784F:7814 7D76:7D55 80A6:670C 80CA:6710 80D0:670F 80F6:3B35 8101:6713 8127:6718 8141:80FC 81A7:6723 853F:848D 8641:8637 8A1E:46B6
8A7D:8A2E 8B8F:8B86 8C63:8C5C 8D86:8D7F 8DFA:8DE5 8E9B:8E97 8F27:8EFF 90DE:90CE 93AE:93AD 96B8:96B7 9E43:9E42 9ED2:9ED1 9FC3:4039 A494:A2CD A49C:A0C0
A49E:A04A A4A7:A458 A4A8:A132 A4AC:A050 A4B0:A3C2 A4BA:A3BF A4BE:A2B1 A4BF:A259 A4C0:A3AB A4C2:A3B5 A4D0:42 A4D1:50 A4D2:64 A4D3:44 A4D4:54 A4D6:47
A4D7:4B A4D9:4A A4DA:43 A4DB:186 A4DC:5A A4DD:46 A4DE:2132 A4DF:4D A4E0:4E A4E1:4C A4E2:53 A4E3:52 A4E5:245 A4E6:56 A4E7:48 A4EA:57 A4EB:58 A4EC:59
A4ED:1660 A4EE:41 A4EF:2C6F A4F0:45 A4F1:18E A4F2:6C A4F3:4F A4F4:55 A4F5:548 A4F7:15E1 A4F8:2E A4F9:2C A4FA:2E,2E A4FB:2E,2C A4FD:3A A4FE:2D,2E
A4FF:3D A60E:2E A644:32 A645:1A8 A647:69 A64D:3C9 A650:42A,6C A651:2C9,62,69 A668:298 A66F:20E9 A67C:306 A67E:2C7 A695:68,314 A698:4F,4F A699:6F,6F
A69A:102A8 A6A1:418 A6B0:16B9 A6B1:2C75 A6CD:2A1 A6CE:245 A6DB:3A0 A6DF:56 A6EB:3F A6EF:32 A6F0:302 A6F1:304 A6F4:A6F3,A6F3 A714:2EB A716:2EA
A728:54,33 A729:74,21D A731:73 A732:41,41 A733:61,61 A734:41,4F A735:61,6F A736:41,55 A737:61,75 A738:41,56 A739:61,76 A73A:41,56 A73B:61,76
A73C:41,59 A73D:61,79 A740:4B,335 A74A:4F,335 A74B:6F,335 A74E:4F,4F A74F:6F,6F A75A:32 A761:77,326 A76A:33 A76B:21D A76E:39 A777:74,66 A778:26
A77A:A779 A789:3A A78C:27 A78F:B7 A795:A727 A798:46 A799:66 A79A:10412 A79B:1043A A79D:29A A79E:A4E4 A79F:75 A7AB:33 A7B1:A4D5 A7B2:4A A7B3:58 A7B4:42
A7B5:DF A7B6:A64C A7B7:3C9 A7D6:DF A7F7:30FC A830:964 A960:1103,1106 A961:1103,1107 A962:1103,1109 A963:1103,110C A964:1105,1100 A965:1105,1100,1100
A966:1105,1103 A967:1105,1103,1103 A968:1105,1106 A969:1105,1107 A96A:1105,1107,1107 A96B:1105,1107,110B A96C:1105,1109 A96D:1105,110C A96E:1105,110F
A96F:1106,1100 A970:1106,1103 A971:1106,1109 A972:1107,1109,1110 A973:1107,110F A974:1107,1112 A975:1109,1109,1107 A976:110B,1105 A977:110B,1112
A978:110C,110C,1112 A979:1110,1110 A97A:1111,1112 A97B:1112,1109 A97C:1159,1159 A992:2C3F A9A3:A99D A9C6:A9D0 A9CF:662 AA53:AA01 AA56:AA23 AB32:65
AB35:66 AB3D:6F AB3E:6F,338 AB3F:254,338 AB41:1DD,6F,338 AB42:1DD,6F,335 AB47:72 AB48:72 AB4D:283 AB4E:75 AB52:75 AB53:3C7 AB55:3C7 AB5A:79 AB60:459
AB62:254,65 AB63:75,6F AB70:1D05 AB71:280 AB72:1D1B AB74:6F,31B AB75:69 AB7A:1D00 AB7B:1D0A AB7C:1D07 AB7E:242 AB80:2C76 AB81:72 AB83:77 AB87:28D
AB8B:29C AB8E:6F,335 AB90:262 AB93:7A AB9B:A793 AB9C:75,335 AB9F:185 ABA2:280 ABA9:76 ABAA:73 ABAE:29F ABAF:63 ABB2:1D18 ABB6:138 ABBB:6F,335
D7B0:1169,1167 D7B1:1169,1169,4E28 D7B2:116D,1161 D7B3:116D,1161,4E28 D7B4:116D,1165 D7B5:116E,1167 D7B6:116E,4E28,4E28 D7B7:1172,1161,4E28
D7B8:1172,1169 D7B9:30FC,1161 D7BA:30FC,1165 D7BB:30FC,1165,4E28 D7BC:30FC,1169 D7BD:4E28,1163,1169 D7BE:4E28,1163,4E28 D7BF:4E28,1167
D7C0:4E28,1167,4E28 D7C1:4E28,1169,4E28 D7C2:4E28,116D D7C3:4E28,1172 D7C4:4E28,4E28 D7C5:119E,1161 D7C6:119E,1165,4E28 D7CB:1102,1105 D7CC:1102,110E
D7CD:1103,1103 D7CE:1103,1103,1107 D7CF:1103,1107 D7D0:1103,1109 D7D1:1103,1109,1100 D7D2:1103,110C D7D3:1103,110E D7D4:1103,1110 D7D5:1105,1100,1100
D7D6:1105,1100,1112 D7D7:1105,1105,110F D7D8:1105,1106,1112 D7D9:1105,1107,1103 D7DA:1105,1107,1111 D7DB:1105,114C D7DC:1105,1159,1112 D7DD:1105,110B
D7DE:1106,1102 D7DF:1106,1102,1102 D7E0:1106,1106 D7E1:1106,1107,1109 D7E2:1106,110C D7E3:1107,1103 D7E4:1107,1105,1111 D7E5:1107,1106 D7E6:1107,1107
D7E7:1107,1109,1103 D7E8:1107,110C D7E9:1107,110E D7EA:1109,1106 D7EB:1109,1107,110B D7EC:1109,1109,1100 D7ED:1109,1109,1103 D7EE:1109,1140
D7EF:1109,110C D7F0:1109,110E D7F1:1109,1110 D7F2:1105,1112 D7F3:1140,1107 D7F4:1140,1107,110B D7F5:114C,1106 D7F6:114C,1112 D7F7:110C,1107
D7F8:110C,1107,1107 D7F9:110C,110C D7FA:1111,1109 D7FB:1111,1110 FB00:66,66 FB01:66,69 FB02:66,6C FB03:66,66,69 FB04:66,66,6C FB06:73,74 FB13:574,576
FB14:574,565 FB15:574,56B FB16:57E,576 FB17:574,56D FB20:5E2 FB21:5D0 FB22:5D3 FB23:5D4 FB24:5DB FB25:5DC FB26:5DD FB27:5E8 FB28:5EA FB29:2D,307
FB4F:5D0,5DC FB50:671 FB51:671 FB52:67B FB53:67B FB54:67B FB55:67B FB56:649,6DB FB57:649,6DB FB58:649,6DB FB59:649,6DB FB5A:680 FB5B:680 FB5C:680
FB5D:680 FB5E:67A FB5F:67A FB60:67A FB61:67A FB62:67F FB63:67F FB64:67F FB65:67F FB66:649,615 FB67:649,615 FB68:649,615 FB69:649,615 FB6A:6A1,6DB
FB6B:6A1,6DB FB6C:6A1,6DB FB6D:6A1,6DB FB6E:6A6 FB6F:6A6 FB70:6A6 FB71:6A6 FB72:684 FB73:684 FB74:684 FB75:684 FB76:683 FB77:683 FB78:683 FB79:683
FB7A:686 FB7B:686 FB7C:686 FB7D:686 FB7E:687 FB7F:687 FB80:687 FB81:687 FB82:68D FB83:68D FB84:68C FB85:68C FB86:62F,6DB FB87:62F,6DB FB88:62F,615
FB89:62F,615 FB8A:631,6DB FB8B:631,6DB FB8C:631,615 FB8D:631,615 FB8E:643 FB8F:643 FB90:643 FB91:643 FB92:6AF FB93:6AF FB94:6AF FB95:6AF FB96:6B3
FB97:6B3 FB98:6B3 FB99:6B3 FB9A:6B1 FB9B:6B1 FB9C:6B1 FB9D:6B1 FB9E:649 FB9F:649 FBA0:649,615 FBA1:649,615 FBA2:649,615 FBA3:649,615 FBA4:6D5,654
FBA5:6D5,654 FBA6:6F FBA7:6F FBA8:6F FBA9:6F FBAA:6F FBAB:6F FBAC:6F FBAD:6F FBAE:649 FBAF:649 FBB0:6D2,654 FBB1:6D2,654 FBD3:643,6DB FBD4:643,6DB
FBD5:643,6DB FBD6:643,6DB FBD7:648,313 FBD8:648,313 FBD9:648,306 FBDA:648,306 FBDB:648,670 FBDC:648,670 FBDD:648,313,674 FBDE:648,6DB FBDF:648,6DB
FBE0:6C5 FBE1:6C5 FBE2:648,302 FBE3:648,302 FBE4:67B FBE5:67B FBE6:67B FBE7:67B FBE8:649 FBE9:649 FBEA:649,674,6C FBEB:649,674,6C FBEC:649,674,6F
FBED:649,674,6F FBEE:649,674,648 FBEF:649,674,648 FBF0:649,674,648,313 FBF1:649,674,648,313 FBF2:649,674,648,306 FBF3:649,674,648,306
FBF4:649,674,648,670 FBF5:649,674,648,670 FBF6:649,674,67B FBF7:649,674,67B FBF8:649,674,67B FBF9:649,674,649 FBFA:649,674,649 FBFB:649,674,649
FBFC:649 FBFD:649 FBFE:649 FBFF:649 FC00:649,674,62C FC01:649,674,62D FC02:649,674,645 FC03:649,674,649 FC04:649,674,649 FC05:628,62C FC06:628,62D
FC07:628,62E FC08:628,645 FC09:628,649 FC0A:628,649 FC0B:62A,62C FC0C:62A,62D FC0D:62A,62E FC0E:62A,645 FC0F:62A,649 FC10:62A,649 FC11:649,6DB,62C
FC12:649,6DB,645 FC13:649,6DB,649 FC14:649,6DB,649 FC15:62C,62D FC16:62C,645 FC17:62D,62C FC18:62D,645 FC19:62E,62C FC1A:62E,62D FC1B:62E,645
FC1C:633,62C FC1D:633,62D FC1E:633,62E FC1F:633,645 FC20:635,62D FC21:635,645 FC22:636,62C FC23:636,62D FC24:636,62E FC25:636,645 FC26:637,62D
FC27:637,645 FC28:638,645 FC29:639,62C FC2A:639,645 FC2B:63A,62C FC2C:63A,645 FC2D:641,62C FC2E:641,62D FC2F:641,62E FC30:641,645 FC31:641,649
FC32:641,649 FC33:642,62D FC34:642,645 FC35:642,649 FC36:642,649 FC37:643,6C FC38:643,62C FC39:643,62D FC3A:643,62E FC3B:643,644 FC3C:643,645
FC3D:643,649 FC3E:643,649 FC3F:644,62C FC40:644,62D FC41:644,62E FC42:644,645 FC43:644,649 FC44:644,649 FC45:645,62C FC46:645,62D FC47:645,62E
FC48:645,645 FC49:645,649 FC4A:645,649 FC4B:628,62E FC4C:646,62D FC4D:646,62E FC4E:646,645 FC4F:646,649 FC50:646,649 FC51:6F,62C FC52:6F,645
FC53:6F,649 FC54:6F,649 FC55:649,62C FC56:649,62D FC57:649,62E FC58:649,645 FC59:649,649 FC5A:649,649 FC5B:630,670 FC5C:631,670 FC5D:649,670
FC5E:FE72,651 FC5F:FE74,651 FC60:FE76,651 FC61:FE78,651 FC62:FE7A,651 FC63:FE7C,670 FC64:649,674,631 FC65:649,674,632 FC66:649,674,645
FC67:649,674,646 FC68:649,674,649 FC69:649,674,649 FC6A:628,631 FC6B:628,632 FC6C:628,645 FC6D:628,646 FC6E:628,649 FC6F:628,649 FC70:62A,631
FC71:62A,632 FC72:62A,645 FC73:62A,646 FC74:62A,649 FC75:62A,649 FC76:649,6DB,631 FC77:649,6DB,632 FC78:649,6DB,645 FC79:649,6DB,646 FC7A:649,6DB,649
FC7B:649,6DB,649 FC7C:641,649 FC7D:641,649 FC7E:642,649 FC7F:642,649 FC80:643,6C FC81:643,644 FC82:643,645 FC83:643,649 FC84:643,649 FC85:644,645
FC86:644,649 FC87:644,649 FC88:645,6C FC89:645,645 FC8A:646,631 FC8B:646,632 FC8C:646,645 FC8D:646,646 FC8E:646,649 FC8F:646,649 FC90:649,670
FC91:649,631 FC92:649,632 FC93:649,645 FC94:649,646 FC95:649,649 FC96:649,649 FC97:649,674,62C FC98:649,674,62D FC99:649,674,62E FC9A:649,674,645
FC9B:649,674,6F FC9C:628,62C FC9D:628,62D FC9E:628,62E FC9F:628,645 FCA0:628,6F FCA1:62A,62C FCA2:62A,62D FCA3:62A,62E FCA4:62A,645 FCA5:62A,6F
FCA6:649,6DB,645 FCA7:62C,62D FCA8:62C,645 FCA9:62D,62C FCAA:62D,645 FCAB:62E,62C FCAC:62E,645 FCAD:633,62C FCAE:633,62D FCAF:633,62E FCB0:633,645
FCB1:635,62D FCB2:635,62E FCB3:635,645 FCB4:636,62C FCB5:636,62D FCB6:636,62E FCB7:636,645 FCB8:637,62D FCB9:638,645 FCBA:639,62C FCBB:639,645
FCBC:63A,62C FCBD:63A,645 FCBE:641,62C FCBF:641,62D FCC0:641,62E FCC1:641,645 FCC2:642,62D FCC3:642,645 FCC4:643,62C FCC5:643,62D FCC6:643,62E
FCC7:643,644 FCC8:643,645 FCC9:644,62C FCCA:644,62D FCCB:644,62E FCCC:644,645 FCCD:644,6F FCCE:645,62C FCCF:645,62D FCD0:645,62E FCD1:645,645
FCD2:628,62E FCD3:646,62D FCD4:646,62E FCD5:646,645 FCD6:646,6F FCD7:6F,62C FCD8:6F,645 FCD9:6F,670 FCDA:649,62C FCDB:649,62D FCDC:649,62E
FCDD:649,645 FCDE:649,6F FCDF:649,674,645 FCE0:649,674,6F FCE1:628,645 FCE2:628,6F FCE3:62A,645 FCE4:62A,6F FCE5:649,6DB,645 FCE6:649,6DB,6F
FCE7:633,645 FCE8:633,6F FCE9:633,6DB,645 FCEA:633,6DB,6F FCEB:643,644 FCEC:643,645 FCED:644,645 FCEE:646,645 FCEF:646,6F FCF0:649,645 FCF1:649,6F
FCF2:FE77,651 FCF3:FE79,651 FCF4:FE7B,651 FCF5:637,649 FCF6:637,649 FCF7:639,649 FCF8:639,649 FCF9:63A,649 FCFA:63A,649 FCFB:633,649 FCFC:633,649
FCFD:633,6DB,649 FCFE:633,6DB,649 FCFF:62D,649 FD00:62D,649 FD01:62C,649 FD02:62C,649 FD03:62E,649 FD04:62E,649 FD05:635,649 FD06:635,649 FD07:636,649
FD08:636,649 FD09:633,6DB,62C FD0A:633,6DB,62D FD0B:633,6DB,62E FD0C:633,6DB,645 FD0D:633,6DB,631 FD0E:633,631 FD0F:635,631 FD10:636,631 FD11:637,649
FD12:637,649 FD13:639,649 FD14:639,649 FD15:63A,649 FD16:63A,649 FD17:633,649 FD18:633,649 FD19:633,6DB,649 FD1A:633,6DB,649 FD1B:62D,649 FD1C:62D,649
FD1D:62C,649 FD1E:62C,649 FD1F:62E,649 FD20:62E,649 FD21:635,649 FD22:635,649 FD23:636,649 FD24:636,649 FD25:633,6DB,62C FD26:633,6DB,62D
FD27:633,6DB,62E FD28:633,6DB,645 FD29:633,6DB,631 FD2A:633,631 FD2B:635,631 FD2C:636,631 FD2D:633,6DB,62C FD2E:633,6DB,62D FD2F:633,6DB,62E
FD30:633,6DB,645 FD31:633,6F FD32:633,6DB,6F FD33:637,645 FD34:633,62C FD35:633,62D FD36:633,62E FD37:633,6DB,62C FD38:633,6DB,62D FD39:633,6DB,62E
FD3A:637,645 FD3B:638,645 FD3C:6C,30B FD3D:6C,30B FD3E:28 FD3F:29 FD50:62A,62C,645 FD51:62A,62D,62C FD52:62A,62D,62C FD53:62A,62D,645 FD54:62A,62E,645
FD55:62A,645,62C FD56:62A,645,62D FD57:62A,645,62E FD58:62C,645,62D FD59:62C,645,62D FD5A:62D,645,649 FD5B:62D,645,649 FD5C:633,62D,62C
FD5D:633,62C,62D FD5E:633,62C,649 FD5F:633,645,62D FD60:633,645,62D FD61:633,645,62C FD62:633,645,645 FD63:633,645,645 FD64:635,62D,62D
FD65:635,62D,62D FD66:635,645,645 FD67:633,6DB,62D,645 FD68:633,6DB,62D,645 FD69:633,6DB,62C,649 FD6A:633,6DB,645,62E FD6B:633,6DB,645,62E
FD6C:633,6DB,645,645 FD6D:633,6DB,645,645 FD6E:636,62D,649 FD6F:636,62E,645 FD70:636,62E,645 FD71:637,645,62D FD72:637,645,62D FD73:637,645,645
FD74:637,645,649 FD75:639,62C,645 FD76:639,645,645 FD77:639,645,645 FD78:639,645,649 FD79:63A,645,645 FD7A:63A,645,649 FD7B:63A,645,649
FD7C:641,62E,645 FD7D:641,62E,645 FD7E:642,645,62D FD7F:642,645,645 FD80:644,62D,645 FD81:644,62D,649 FD82:644,62D,649 FD83:644,62C,62C
FD84:644,62C,62C FD85:644,62E,645 FD86:644,62E,645 FD87:644,645,62D FD88:644,645,62D FD89:645,62D,62C FD8A:645,62D,645 FD8B:645,62D,649
FD8C:645,62C,62D FD8D:645,62C,645 FD8E:645,62E,62C FD8F:645,62E,645 FD92:645,62C,62E FD93:6F,645,62C FD94:6F,645,645 FD95:646,62D,645 FD96:646,62D,649
FD97:646,62C,645 FD98:646,62C,645 FD99:646,62C,649 FD9A:646,645,649 FD9B:646,645,649 FD9C:649,645,645 FD9D:649,645,645 FD9E:628,62E,649
FD9F:62A,62C,649 FDA0:62A,62C,649 FDA1:62A,62E,649 FDA2:62A,62E,649 FDA3:62A,645,649 FDA4:62A,645,649 FDA5:62C,645,649 FDA6:62C,62D,649
FDA7:62C,645,649 FDA8:633,62E,649 FDA9:635,62D,649 FDAA:633,6DB,62D,649 FDAB:636,62D,649 FDAC:644,62C,649 FDAD:644,645,649 FDAE:649,62D,649
FDAF:649,62C,649 FDB0:649,645,649 FDB1:645,645,649 FDB2:642,645,649 FDB3:646,62D,649 FDB4:642,645,62D FDB5:644,62D,645 FDB6:639,645,649
FDB7:643,645,649 FDB8:646,62C,62D FDB9:645,62E,649 FDBA:644,62C,645 FDBB:643,645,645 FDBC:644,62C,645 FDBD:646,62C,62D FDBE:62C,62D,649
FDBF:62D,62C,649 FDC0:645,62C,649 FDC1:641,645,649 FDC2:628,62D,649 FDC3:643,645,645 FDC4:639,62C,645 FDC5:635,645,645 FDC6:633,62E,649
FDC7:646,62C,649 FDF0:635,644,649 FDF1:642,644,649 FDF2:6C,644,644,651,670,6F FDF3:6C,643,628,631 FDF4:645,62D,645,62F FDF5:635,644,639,645
FDF6:631,633,648,644 FDF7:639,644,649,6F FDF8:648,633,644,645 FDF9:635,644,649 FDFA:635,644,649,20,6C,644,644,6F,20,639,644,649,6F,20,648,633,644,645
FDFB:62C,644,20,62C,644,6C,644,6F FDFC:631,649,6C,644 FE00: FE01: FE02: FE03: FE04: FE05: FE06: FE07: FE08: FE09: FE0A: FE0B: FE0C: FE0D: FE0E: FE0F:
FE19:2D57 FE30:3A FE31:2502 FE34:2307 FE35:23DC FE36:23DD FE37:23DE FE38:23DF FE39:23E0 FE3A:23E1 FE49:2C9 FE4A:2C9 FE4B:2C9 FE4C:2C9 FE4D:5F FE4E:5F
FE4F:5F FE58:2D FE68:5C FE80:621 FE81:627,653 FE82:627,653 FE83:6C,674 FE84:6C,674 FE85:648,674 FE86:648,674 FE87:6C,655 FE88:6C,655 FE89:649,674
FE8A:649,674 FE8B:649,674 FE8C:649,674 FE8D:6C FE8E:6C FE8F:628 FE90:628 FE91:628 FE92:628 FE93:629 FE94:629 FE95:62A FE96:62A FE97:62A FE98:62A
FE99:649,6DB FE9A:649,6DB FE9B:649,6DB FE9C:649,6DB FE9D:62C FE9E:62C FE9F:62C FEA0:62C FEA1:62D FEA2:62D FEA3:62D FEA4:62D FEA5:62E FEA6:62E FEA7:62E
FEA8:62E FEA9:62F FEAA:62F FEAB:630 FEAC:630 FEAD:631 FEAE:631 FEAF:632 FEB0:632 FEB1:633 FEB2:633 FEB3:633 FEB4:633 FEB5:633,6DB FEB6:633,6DB
FEB7:633,6DB FEB8:633,6DB FEB9:635 FEBA:635 FEBB:635 FEBC:635 FEBD:636 FEBE:636 FEBF:636 FEC0:636 FEC1:637 FEC2:637 FEC3:637 FEC4:637 FEC5:638
FEC6:638 FEC7:638 FEC8:638 FEC9:639 FECA:639 FECB:639 FECC:639 FECD:63A FECE:63A FECF:63A FED0:63A FED1:641 FED2:641 FED3:641 FED4:641 FED5:642
FED6:642 FED7:642 FED8:642 FED9:643 FEDA:643 FEDB:643 FEDC:643 FEDD:644 FEDE:644 FEDF:644 FEE0:644 FEE1:645 FEE2:645 FEE3:645 FEE4:645 FEE5:646
FEE6:646 FEE7:646 FEE8:646 FEE9:6F FEEA:6F FEEB:6F FEEC:6F FEED:648 FEEE:648 FEEF:649 FEF0:649 FEF1:649 FEF2:649 FEF3:649 FEF4:649 FEF5:644,627,653
FEF6:644,627,653 FEF7:644,6C,674 FEF8:644,6C,674 FEF9:644,6C,655 FEFA:644,6C,655 FEFB:644,6C FEFC:644,6C FEFF: FF01:21 FF02:27,27 FF07:27 FF0D:30FC
FF1A:3A FF21:41 FF22:42 FF23:43 FF25:45 FF28:48 FF29:6C FF2A:4A FF2B:4B FF2D:4D FF2E:4E FF2F:4F FF30:50 FF33:53 FF34:54 FF38:58 FF39:59 FF3A:5A
FF3B:28 FF3C:5C FF3D:29 FF3E:FE3F FF40:27 FF41:61 FF43:63 FF45:65 FF47:67 FF48:68 FF49:69 FF4A:6A FF4C:6C FF4F:6F FF50:70 FF53:73 FF56:76 FF58:78
FF59:79 FF5C:2502 FF5E:301C FF65:B7 FFA0: FFE3:2C9 FFE8:6C FFED:25AA 10101:B7 1018E:4E,30A 10196:58,335 10197:56,335 10198:6C,335,6C,335,53,335
10199:6C,335,6C,335 101A0:2CE8 10282:42 10285:394 10286:45 10287:46 1028A:6C 1028D:245 10290:58 10292:4F 10294:16DC 10295:50 10296:53 10297:54
1029B:2B 102A0:41 102A1:42 102A2:43 102A3:394 102A5:46 102AB:4F 102AD:3D8 102B0:4D 102B1:54 102B2:59 102B3:3A6 102B4:58 102B5:3A8 102B6:3A9 102B8:2D40
102CF:48 102E1:62F 102E4:648 102E8:637 102F2:635 102F5:5A 10301:42 10302:43 10309:6C 10311:4D 10312:3D8 10315:54 10317:58 1031A:38 1031F:2A 10320:6C
10322:58 103D1:10382 103D3:10393 10401:190 10404:4F 10411:A4F6 10415:43 1041B:4C 1041F:2C70 10420:53 10423:186 10425:418 10429:A793 1042A:29A 1042C:6F
1043D:63 1043F:277 10442:25E 10443:29F 10448:73 1044B:254 1044D:1D0E 104A0:10486 104B0:245 104B4:52 104BC:4C3 104C2:4F 104C3:298 104C4:DE 104CD:40B
104CE:55 104D0:16E6 104D1:3A8 104D2:37 104D8:28C 104DB:3BB 104EA:6F 104EB:A669 104F6:75 104F9:3C8 10513:4E 10516:4F 10518:4B 1051C:43 1051D:56
10525:46 10526:4C 10527:58 10A3A:323 10A50:2E 10A57:10A56,10A56 10CFA:10CA5 10CFC:10C82 110BB:970 111C7:970 111CA:323 111CB:93A 111DB:A8FC 111DC:A8FB
111DE:2248 11300:30A 11413:11434,11442,11412 11419:11434,11442,11418 11424:11434,11442,11423 1142A:11434,11442,11429 1142D:11434,11442,1142C
1142F:11434,11442,1142E 1144C:1144B,1144B 11492:998 11494:99A 11496:99C 11498:99E 11499:99F 1149B:9A1 1149D:9B2 1149E:9A4 1149F:9A5 114A0:9A6
114A1:9A7 114A2:9A8 114A3:9AA 114A7:9AE 114A8:9AF 114A9:9AC 114AA:9A3 114AB:9B0 114AD:9B7 114AE:9B8 114B0:9BE 114B1:9BF 114B9:9C7 114BD:9D7
114BF:306,307 114C1:983 114C2:9CD 114C3:323 114C4:9BD 114C5:77,307 114D0:4F 114D1:9E7 114D2:9E8 114D6:9EC 115D8:11582 115D9:11582 115DA:11583
115DB:11584 115DC:115B2 115DD:115B3 11642:11641,11641 11700:72,6E 11706:76 1170A:77 1170E:77 1170F:77 118A0:56 118A2:46 118A3:4C 118A4:59 118A6:45
118A8:2207 118A9:5A 118AC:39 118AE:45 118AF:34 118B2:4C 118B5:4F 118B7:16DC 118B8:55 118BB:35 118BC:54 118C0:76 118C1:73 118C2:46 118C3:69 118C4:7A
118C6:37 118C8:6F 118CA:33 118CC:39 118CE:A793 118D5:36 118D6:39 118D7:6F 118D8:75 118DC:79 118E0:4F 118E3:72,6E 118E4:669 118E5:5A 118E6:57 118E9:43
118EC:58 118EF:57 118F2:43 11AE6:11AE5,11AEF 11AE7:11AE5,11AF0 11AE8:11AE5,11AE5 11AE9:11AE5,11AE5,11AEF 11AEA:11AE5,11AE5,11AF0 11AEC:11AEB,11AEF
11AED:11AEB,11AEB 11AEE:11AEB,11AEB,11AEF 11AF4:11AF3,11AEF 11AF5:11AF3,11AF0 11AF6:11AF3,11AF3 11AF7:11AF3,11AF3,11AEF 11AF8:11AF3,11AF3,11AF0
11C42:11C41,11C41 11CB2:11CAA 12038:1039A 132F9:1099E 16F07:393 16F08:56 16F0A:54 16F16:4C 16F1A:394 16F1C:A658 16F26:A4F6 16F28:6C 16F2D:190 16F35:52
16F3A:53 16F3B:33 16F3D:245 16F3F:3E 16F40:41 16F42:55 16F43:59 16F51:27 16F52:27 1BCA0: 1BCA1: 1BCA2: 1BCA3: 1D114:7B 1D16D:2E 1D173: 1D174: 1D175:
1D176: 1D177: 1D178: 1D179: 1D17A: 1D202:4FE 1D206:33 1D20B:418 1D20D:56 1D20F:5C 1D212:37 1D213:46 1D214:102BC 1D215:A4F6 1D216:52 1D217:2C6F
1D21A:4F,335 1D21B:2144 1D21C:A4D5 1D221:190 1D222:460 1D22A:4C 1D22B:A4F6 1D230:A7FB 1D236:3C 1D237:3E 1D238:228F 1D239:2290 1D23A:2F 1D23B:5C
1D23F:16CB 1D245:548 1D400:41 1D401:42 1D402:43 1D403:44 1D404:45 1D405:46 1D406:47 1D407:48 1D408:6C 1D409:4A 1D40A:4B 1D40B:4C 1D40C:4D 1D40D:4E
1D40E:4F 1D40F:50 1D410:51 1D411:52 1D412:53 1D413:54 1D414:55 1D415:56 1D416:57 1D417:58 1D418:59 1D419:5A 1D41A:61 1D41B:62 1D41C:63 1D41D:64
1D41E:65 1D41F:66 1D420:67 1D421:68 1D422:69 1D423:6A 1D424:6B 1D425:6C 1D426:72,6E 1D427:6E 1D428:6F 1D429:70 1D42A:71 1D42B:72 1D42C:73 1D42D:74
1D42E:75 1D42F:76 1D430:77 1D431:78 1D432:79 1D433:7A 1D434:41 1D435:42 1D436:43 1D437:44 1D438:45 1D439:46 1D43A:47 1D43B:48 1D43C:6C 1D43D:4A
1D43E:4B 1D43F:4C 1D440:4D 1D441:4E 1D442:4F 1D443:50 1D444:51 1D445:52 1D446:53 1D447:54 1D448:55 1D449:56 1D44A:57 1D44B:58 1D44C:59 1D44D:5A
1D44E:61 1D44F:62 1D450:63 1D451:64 1D452:65 1D453:66 1D454:67 1D456:69 1D457:6A 1D458:6B 1D459:6C 1D45A:72,6E 1D45B:6E 1D45C:6F 1D45D:70 1D45E:71
1D45F:72 1D460:73 1D461:74 1D462:75 1D463:76 1D464:77 1D465:78 1D466:79 1D467:7A 1D468:41 1D469:42 1D46A:43 1D46B:44 1D46C:45 1D46D:46 1D46E:47
1D46F:48 1D470:6C 1D471:4A 1D472:4B 1D473:4C 1D474:4D 1D475:4E 1D476:4F 1D477:50 1D478:51 1D479:52 1D47A:53 1D47B:54 1D47C:55 1D47D:56 1D47E:57
1D47F:58 1D480:59 1D481:5A 1D482:61 1D483:62 1D484:63 1D485:64 1D486:65 1D487:66 1D488:67 1D489:68 1D48A:69 1D48B:6A 1D48C:6B 1D48D:6C 1D48E:72,6E
1D48F:6E 1D490:6F 1D491:70 1D492:71 1D493:72 1D494:73 1D495:74 1D496:75 1D497:76 1D498:77 1D499:78 1D49A:79 1D49B:7A 1D49C:41 1D49E:43 1D49F:44
1D4A2:47 1D4A5:4A 1D4A6:4B 1D4A9:4E 1D4AA:4F 1D4AB:50 1D4AC:51 1D4AE:53 1D4AF:54 1D4B0:55 1D4B1:56 1D4B2:57 1D4B3:58 1D4B4:59 1D4B5:5A 1D4B6:61
1D4B7:62 1D4B8:63 1D4B9:64 1D4BB:66 1D4BD:68 1D4BE:69 1D4BF:6A 1D4C0:6B 1D4C1:6C 1D4C2:72,6E 1D4C3:6E 1D4C5:70 1D4C6:71 1D4C7:72 1D4C8:73 1D4C9:74
1D4CA:75 1D4CB:76 1D4CC:77 1D4CD:78 1D4CE:79 1D4CF:7A 1D4D0:41 1D4D1:42 1D4D2:43 1D4D3:44 1D4D4:45 1D4D5:46 1D4D6:47 1D4D7:48 1D4D8:6C 1D4D9:4A
1D4DA:4B 1D4DB:4C 1D4DC:4D 1D4DD:4E 1D4DE:4F 1D4DF:50 1D4E0:51 1D4E1:52 1D4E2:53 1D4E3:54 1D4E4:55 1D4E5:56 1D4E6:57 1D4E7:58 1D4E8:59 1D4E9:5A
1D4EA:61 1D4EB:62 1D4EC:63 1D4ED:64 1D4EE:65 1D4EF:66 1D4F0:67 1D4F1:68 1D4F2:69 1D4F3:6A 1D4F4:6B 1D4F5:6C 1D4F6:72,6E 1D4F7:6E 1D4F8:6F 1D4F9:70
1D4FA:71 1D4FB:72 1D4FC:73 1D4FD:74 1D4FE:75 1D4FF:76 1D500:77 1D501:78 1D502:79 1D503:7A 1D504:41 1D505:42 1D507:44 1D508:45 1D509:46 1D50A:47
1D50D:4A 1D50E:4B 1D50F:4C 1D510:4D 1D511:4E 1D512:4F 1D513:50 1D514:51 1D516:53 1D517:54 1D518:55 1D519:56 1D51A:57 1D51B:58 1D51C:59 1D51E:61
1D51F:62 1D520:63 1D521:64 1D522:65 1D523:66 1D524:67 1D525:68 1D526:69 1D527:6A 1D528:6B 1D529:6C 1D52A:72,6E 1D52B:6E 1D52C:6F 1D52D:70 1D52E:71
1D52F:72 1D530:73 1D531:74 1D532:75 1D533:76 1D534:77 1D535:78 1D536:79 1D537:7A 1D538:41 1D539:42 1D53B:44 1D53C:45 1D53D:46 1D53E:47 1D540:6C
1D541:4A 1D542:4B 1D543:4C 1D544:4D 1D546:4F 1D54A:53 1D54B:54 1D54C:55 1D54D:56 1D54E:57 1D54F:58 1D550:59 1D552:61 1D553:62 1D554:63 1D555:64
1D556:65 1D557:66 1D558:67 1D559:68 1D55A:69 1D55B:6A 1D55C:6B 1D55D:6C 1D55E:72,6E 1D55F:6E 1D560:6F 1D561:70 1D562:71 1D563:72 1D564:73 1D565:74
1D566:75 1D567:76 1D568:77 1D569:78 1D56A:79 1D56B:7A 1D56C:41 1D56D:42 1D56E:43 1D56F:44 1D570:45 1D571:46 1D572:47 1D573:48 1D574:6C 1D575:4A
1D576:4B 1D577:4C 1D578:4D 1D579:4E 1D57A:4F 1D57B:50 1D57C:51 1D57D:52 1D57E:53 1D57F:54 1D580:55 1D581:56 1D582:57 1D583:58 1D584:59 1D585:5A
1D586:61 1D587:62 1D588:63 1D589:64 1D58A:65 1D58B:66 1D58C:67 1D58D:68 1D58E:69 1D58F:6A 1D590:6B 1D591:6C 1D592:72,6E 1D593:6E 1D594:6F 1D595:70
1D596:71 1D597:72 1D598:73 1D599:74 1D59A:75 1D59B:76 1D59C:77 1D59D:78 1D59E:79 1D59F:7A 1D5A0:41 1D5A1:42 1D5A2:43 1D5A3:44 1D5A4:45 1D5A5:46
1D5A6:47 1D5A7:48 1D5A8:6C 1D5A9:4A 1D5AA:4B 1D5AB:4C 1D5AC:4D 1D5AD:4E 1D5AE:4F 1D5AF:50 1D5B0:51 1D5B1:52 1D5B2:53 1D5B3:54 1D5B4:55 1D5B5:56
1D5B6:57 1D5B7:58 1D5B8:59 1D5B9:5A 1D5BA:61 1D5BB:62 1D5BC:63 1D5BD:64 1D5BE:65 1D5BF:66 1D5C0:67 1D5C1:68 1D5C2:69 1D5C3:6A 1D5C4:6B 1D5C5:6C
1D5C6:72,6E 1D5C7:6E 1D5C8:6F 1D5C9:70 1D5CA:71 1D5CB:72 1D5CC:73 1D5CD:74 1D5CE:75 1D5CF:76 1D5D0:77 1D5D1:78 1D5D2:79 1D5D3:7A 1D5D4:41 1D5D5:42
1D5D6:43 1D5D7:44 1D5D8:45 1D5D9:46 1D5DA:47 1D5DB:48 1D5DC:6C 1D5DD:4A 1D5DE:4B 1D5DF:4C 1D5E0:4D 1D5E1:4E 1D5E2:4F 1D5E3:50 1D5E4:51 1D5E5:52
1D5E6:53 1D5E7:54 1D5E8:55 1D5E9:56 1D5EA:57 1D5EB:58 1D5EC:59 1D5ED:5A 1D5EE:61 1D5EF:62 1D5F0:63 1D5F1:64 1D5F2:65 1D5F3:66 1D5F4:67 1D5F5:68
1D5F6:69 1D5F7:6A 1D5F8:6B 1D5F9:6C 1D5FA:72,6E 1D5FB:6E 1D5FC:6F 1D5FD:70 1D5FE:71 1D5FF:72 1D600:73 1D601:74 1D602:75 1D603:76 1D604:77 1D605:78
1D606:79 1D607:7A 1D608:41 1D609:42 1D60A:43 1D60B:44 1D60C:45 1D60D:46 1D60E:47 1D60F:48 1D610:6C 1D611:4A 1D612:4B 1D613:4C 1D614:4D 1D615:4E
1D616:4F 1D617:50 1D618:51 1D619:52 1D61A:53 1D61B:54 1D61C:55 1D61D:56 1D61E:57 1D61F:58 1D620:59 1D621:5A 1D622:61 1D623:62 1D624:63 1D625:64
1D626:65 1D627:66 1D628:67 1D629:68 1D62A:69 1D62B:6A 1D62C:6B 1D62D:6C 1D62E:72,6E 1D62F:6E 1D630:6F 1D631:70 1D632:71 1D633:72 1D634:73 1D635:74
1D636:75 1D637:76 1D638:77 1D639:78 1D63A:79 1D63B:7A 1D63C:41 1D63D:42 1D63E:43 1D63F:44 1D640:45 1D641:46 1D642:47 1D643:48 1D644:6C 1D645:4A
1D646:4B 1D647:4C 1D648:4D 1D649:4E 1D64A:4F 1D64B:50 1D64C:51 1D64D:52 1D64E:53 1D64F:54 1D650:55 1D651:56 1D652:57 1D653:58 1D654:59 1D655:5A
1D656:61 1D657:62 1D658:63 1D659:64 1D65A:65 1D65B:66 1D65C:67 1D65D:68 1D65E:69 1D65F:6A 1D660:6B 1D661:6C 1D662:72,6E 1D663:6E 1D664:6F 1D665:70
1D666:71 1D667:72 1D668:73 1D669:74 1D66A:75 1D66B:76 1D66C:77 1D66D:78 1D66E:79 1D66F:7A 1D670:41 1D671:42 1D672:43 1D673:44 1D674:45 1D675:46
1D676:47 1D677:48 1D678:6C 1D679:4A 1D67A:4B 1D67B:4C 1D67C:4D 1D67D:4E 1D67E:4F 1D67F:50 1D680:51 1D681:52 1D682:53 1D683:54 1D684:55 1D685:56
1D686:57 1D687:58 1D688:59 1D689:5A 1D68A:61 1D68B:62 1D68C:63 1D68D:64 1D68E:65 1D68F:66 1D690:67 1D691:68 1D692:69 1D693:6A 1D694:6B 1D695:6C
1D696:72,6E 1D697:6E 1D698:6F 1D699:70 1D69A:71 1D69B:72 1D69C:73 1D69D:74 1D69E:75 1D69F:76 1D6A0:77 1D6A1:78 1D6A2:79 1D6A3:7A 1D6A4:69 1D6A5:237
1D6A8:41 1D6A9:42 1D6AA:393 1D6AB:394 1D6AC:45 1D6AD:5A 1D6AE:48 1D6AF:4F,335 1D6B0:6C 1D6B1:4B 1D6B2:245 1D6B3:4D 1D6B4:4E 1D6B5:39E 1D6B6:4F
1D6B7:3A0 1D6B8:50 1D6B9:4F,335 1D6BA:1A9 1D6BB:54 1D6BC:59 1D6BD:3A6 1D6BE:58 1D6BF:3A8 1D6C0:3A9 1D6C1:2207 1D6C2:61 1D6C3:DF 1D6C4:79 1D6C5:1E9F
1D6C6:A793 1D6C7:3B6 1D6C8:6E,329 1D6C9:4F,335 1D6CA:69 1D6CB:138 1D6CC:3BB 1D6CD:3BC 1D6CE:76 1D6CF:3BE 1D6D0:6F 1D6D1:3C0 1D6D2:70 1D6D3:3C2
1D6D4:6F 1D6D5:1D1B 1D6D6:75 1D6D7:278 1D6D8:3C7 1D6D9:3C8 1D6DA:3C9 1D6DB:2202 1D6DC:A793 1D6DD:4F,335 1D6DE:138 1D6DF:278 1D6E0:70 1D6E1:3C0
1D6E2:41 1D6E3:42 1D6E4:393 1D6E5:394 1D6E6:45 1D6E7:5A 1D6E8:48 1D6E9:4F,335 1D6EA:6C 1D6EB:4B 1D6EC:245 1D6ED:4D 1D6EE:4E 1D6EF:39E 1D6F0:4F
1D6F1:3A0 1D6F2:50 1D6F3:4F,335 1D6F4:1A9 1D6F5:54 1D6F6:59 1D6F7:3A6 1D6F8:58 1D6F9:3A8 1D6FA:3A9 1D6FB:2207 1D6FC:61 1D6FD:DF 1D6FE:79 1D6FF:1E9F
1D700:A793 1D701:3B6 1D702:6E,329 1D703:4F,335 1D704:69 1D705:138 1D706:3BB 1D707:3BC 1D708:76 1D709:3BE 1D70A:6F 1D70B:3C0 1D70C:70 1D70D:3C2
1D70E:6F 1D70F:1D1B 1D710:75 1D711:278 1D712:3C7 1D713:3C8 1D714:3C9 1D715:2202 1D716:A793 1D717:4F,335 1D718:138 1D719:278 1D71A:70 1D71B:3C0
1D71C:41 1D71D:42 1D71E:393 1D71F:394 1D720:45 1D721:5A 1D722:48 1D723:4F,335 1D724:6C 1D725:4B 1D726:245 1D727:4D 1D728:4E 1D729:39E 1D72A:4F
1D72B:3A0 1D72C:50 1D72D:4F,335 1D72E:1A9 1D72F:54 1D730:59 1D731:3A6 1D732:58 1D733:3A8 1D734:3A9 1D735:2207 1D736:61 1D737:DF 1D738:79 1D739:1E9F
1D73A:A793 1D73B:3B6 1D73C:6E,329 1D73D:4F,335 1D73E:69 1D73F:138 1D740:3BB 1D741:3BC 1D742:76 1D743:3BE 1D744:6F 1D745:3C0 1D746:70 1D747:3C2
1D748:6F 1D749:1D1B 1D74A:75 1D74B:278 1D74C:3C7 1D74D:3C8 1D74E:3C9 1D74F:2202 1D750:A793 1D751:4F,335 1D752:138 1D753:278 1D754:70 1D755:3C0
1D756:41 1D757:42 1D758:393 1D759:394 1D75A:45 1D75B:5A 1D75C:48 1D75D:4F,335 1D75E:6C 1D75F:4B 1D760:245 1D761:4D 1D762:4E 1D763:39E 1D764:4F
1D765:3A0 1D766:50 1D767:4F,335 1D768:1A9 1D769:54 1D76A:59 1D76B:3A6 1D76C:58 1D76D:3A8 1D76E:3A9 1D76F:2207 1D770:61 1D771:DF 1D772:79 1D773:1E9F
1D774:A793 1D775:3B6 1D776:6E,329 1D777:4F,335 1D778:69 1D779:138 1D77A:3BB 1D77B:3BC 1D77C:76 1D77D:3BE 1D77E:6F 1D77F:3C0 1D780:70 1D781:3C2
1D782:6F 1D783:1D1B 1D784:75 1D785:278 1D786:3C7 1D787:3C8 1D788:3C9 1D789:2202 1D78A:A793 1D78B:4F,335 1D78C:138 1D78D:278 1D78E:70 1D78F:3C0
1D790:41 1D791:42 1D792:393 1D793:394 1D794:45 1D795:5A 1D796:48 1D797:4F,335 1D798:6C 1D799:4B 1D79A:245 1D79B:4D 1D79C:4E 1D79D:39E 1D79E:4F
1D79F:3A0 1D7A0:50 1D7A1:4F,335 1D7A2:1A9 1D7A3:54 1D7A4:59 1D7A5:3A6 1D7A6:58 1D7A7:3A8 1D7A8:3A9 1D7A9:2207 1D7AA:61 1D7AB:DF 1D7AC:79 1D7AD:1E9F
1D7AE:A793 1D7AF:3B6 1D7B0:6E,329 1D7B1:4F,335 1D7B2:69 1D7B3:138 1D7B4:3BB 1D7B5:3BC 1D7B6:76 1D7B7:3BE 1D7B8:6F 1D7B9:3C0 1D7BA:70 1D7BB:3C2
1D7BC:6F 1D7BD:1D1B 1D7BE:75 1D7BF:278 1D7C0:3C7 1D7C1:3C8 1D7C2:3C9 1D7C3:2202 1D7C4:A793 1D7C5:4F,335 1D7C6:138 1D7C7:278 1D7C8:70 1D7C9:3C0
1D7CA:46 1D7CB:3DD 1D7CE:4F 1D7CF:6C 1D7D0:32 1D7D1:33 1D7D2:34 1D7D3:35 1D7D4:36 1D7D5:37 1D7D6:38 1D7D7:39 1D7D8:4F 1D7D9:6C 1D7DA:32 1D7DB:33
1D7DC:34 1D7DD:35 1D7DE:36 1D7DF:37 1D7E0:38 1D7E1:39 1D7E2:4F 1D7E3:6C 1D7E4:32 1D7E5:33 1D7E6:34 1D7E7:35 1D7E8:36 1D7E9:37 1D7EA:38 1D7EB:39
1D7EC:4F 1D7ED:6C 1D7EE:32 1D7EF:33 1D7F0:34 1D7F1:35 1D7F2:36 1D7F3:37 1D7F4:38 1D7F5:39 1D7F6:4F 1D7F7:6C 1D7F8:32 1D7F9:33 1D7FA:34 1D7FB:35
1D7FC:36 1D7FD:37 1D7FE:38 1D7FF:39 1E8C7:6C 1E8C8:2220 1E8C9:663 1E8CB:38 1E8CC:2202 1E8CD:2202,335 1EE00:6C 1EE01:628 1EE02:62C 1EE03:62F 1EE05:648
1EE06:632 1EE07:62D 1EE08:637 1EE09:649 1EE0A:643 1EE0B:644 1EE0C:645 1EE0D:646 1EE0E:633 1EE0F:639 1EE10:641 1EE11:635 1EE12:642 1EE13:631
1EE14:633,6DB 1EE15:62A 1EE16:649,6DB 1EE17:62E 1EE18:630 1EE19:636 1EE1A:638 1EE1B:63A 1EE1C:649 1EE1D:649 1EE1E:6A1 1EE1F:6A1 1EE21:628 1EE22:62C
1EE24:6F 1EE27:62D 1EE29:649 1EE2A:643 1EE2B:644 1EE2C:645 1EE2D:646 1EE2E:633 1EE2F:639 1EE30:641 1EE31:635 1EE32:642 1EE34:633,6DB 1EE35:62A
1EE36:649,6DB 1EE37:62E 1EE39:636 1EE3B:63A 1EE42:62C 1EE47:62D 1EE49:649 1EE4B:644 1EE4D:646 1EE4E:633 1EE4F:639 1EE51:635 1EE52:642 1EE54:633,6DB
1EE57:62E 1EE59:636 1EE5B:63A 1EE5D:649 1EE5F:6A1 1EE61:628 1EE62:62C 1EE64:6F 1EE67:62D 1EE68:637 1EE69:649 1EE6A:643 1EE6C:645 1EE6D:646 1EE6E:633
1EE6F:639 1EE70:641 1EE71:635 1EE72:642 1EE74:633,6DB 1EE75:62A 1EE76:649,6DB 1EE77:62E 1EE79:636 1EE7A:638 1EE7B:63A 1EE7C:649 1EE7E:6A1 1EE80:6C
1EE81:628 1EE82:62C 1EE83:62F 1EE84:6F 1EE85:648 1EE86:632 1EE87:62D 1EE88:637 1EE89:649 1EE8B:644 1EE8C:645 1EE8D:646 1EE8E:633 1EE8F:639 1EE90:641
1EE91:635 1EE92:642 1EE93:631 1EE94:633,6DB 1EE95:62A 1EE96:649,6DB 1EE97:62E 1EE98:630 1EE99:636 1EE9A:638 1EE9B:63A 1EEA1:628 1EEA2:62C 1EEA3:62F
1EEA5:648 1EEA6:632 1EEA7:62D 1EEA8:637 1EEA9:649 1EEAB:644 1EEAC:645 1EEAD:646 1EEAE:633 1EEAF:639 1EEB0:641 1EEB1:635 1EEB2:642 1EEB3:631
1EEB4:633,6DB 1EEB5:62A 1EEB6:649,6DB 1EEB7:62E 1EEB8:630 1EEB9:636 1EEBA:638 1EEBB:63A 1F100:4F,2E 1F101:4F,2C 1F102:6C,2C 1F103:32,2C 1F104:33,2C
1F105:34,2C 1F106:35,2C 1F107:36,2C 1F108:37,2C 1F109:38,2C 1F10A:39,2C 1F10F:24,20E0 1F110:28,41,29 1F111:28,42,29 1F112:28,43,29 1F113:28,44,29
1F114:28,45,29 1F115:28,46,29 1F116:28,47,29 1F117:28,48,29 1F118:28,6C,29 1F119:28,4A,29 1F11A:28,4B,29 1F11B:28,4C,29 1F11C:28,4D,29 1F11D:28,4E,29
1F11E:28,4F,29 1F11F:28,50,29 1F120:28,51,29 1F121:28,52,29 1F122:28,53,29 1F123:28,54,29 1F124:28,55,29 1F125:28,56,29 1F126:28,57,29 1F127:28,58,29
1F128:28,59,29 1F129:28,5A,29 1F12A:28,53,29 1F16D:33C4,9,20DD 1F16E:43,20E0 1F240:28,672C,29 1F241:28,4E09,29 1F242:28,4E8C,29 1F243:28,5B89,29
1F244:28,70B9,29 1F245:28,6253,29 1F246:28,76D7,29 1F247:28,52DD,29 1F248:28,6557,29 1F312:263D 1F318:263E 1F319:263D 1F700:51,45 1F701:A658 1F702:394
1F704:102BC 1F707:41,52 1F708:56,1DE4 1F70A:2629 1F714:4F,335 1F728:102A8 1F73A:29DF 1F74C:43 1F754:16DC 1F755:22A1 1F75C:73,73,73 1F75E:224F 1F768:54
1F76B:4D,42 1F76C:56,42 1F771:22A0 1FBF0:4F 1FBF1:6C 1FBF2:32 1FBF3:33 1FBF4:34 1FBF5:35 1FBF6:36 1FBF7:37 1FBF8:38 1FBF9:39 21FE8:276C
"""
# End of fixed values.

PROTOTYPE = {int(c, 16): "".join(chr(int(x, 16)) for x in p.split(",") if x) for c, p in (pair.split(":") for pair in _TABLE.split())}
