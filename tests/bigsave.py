"""A snapshot as large as wished, of invented lands whose groups carry the nested lists that real ones do."""

from __future__ import annotations


def big_snapshot(date: str, provinces: int = 2700, groups: int = 12, countries: int = 200, regiments: int = 30) -> bytes:
    """With the defaults, a good 30 MB."""
    nested = lambda name, n, first: f"\t\t{name}=\r\n\t\t{{\r\n" + "".join(f"\t\t\t{first + i}={i}.{i:05d}\r\n" for i in range(n)) + "\t\t}\r\n"
    kinds = ["farmers", "labourers", "soldiers", "clerks", "officers", "artisans"]
    lists = nested("ideology", 7, 1) + nested("issues", 22, 10)
    tags = [f"{chr(65 + i // 26 % 26)}{chr(65 + i % 26)}{i // 676}" for i in range(countries)]
    out = [f'date="{date}"\r\nplayer="{tags[0]}"\r\ngovernment=3\r\nflags=\r\n{{\r\n\tstarted=yes\r\n}}\r\nstart_date="1836.1.1"\r\n']
    number = 0
    for p in range(1, provinces + 1):
        tag = tags[p % countries]
        out.append(f'{p}=\r\n{{\r\n\tname="Land {p}"\r\n\towner="{tag}"\r\n\tcontroller="{tag}"\r\n\tcore="{tag}"\r\n\tgarrison=100.000\r\n\trailroad=\r\n\t{{\r\n\t\t{p % 5}.000 {p % 5}.000\r\n\t}}\r\n')
        for g in range(groups):
            number += 1
            out.append(
                f"\t{kinds[g % 6]}=\r\n\t{{\r\n\t\tid={number}\r\n\t\tsize={1000 + number % 4000}\r\n\t\tcult{p % 17}=creed\r\n\t\tmoney=1.50000\r\n{lists}\t\tcon=1.25\r\n\t\tmil=0.50000\r\n\t\tliteracy=0.{number % 10}5000\r\n"
                f"\t\tbank=0.00000\r\n\t\tluxury_needs=0.10000\r\n\t\teveryday_needs=0.50000\r\n\t\tlife_needs=0.{number % 100:02d}000\r\n\t\trandom={number}\r\n\t}}\r\n"
            )
        out.append("}\r\n")
    for i, tag in enumerate(tags):
        relations = "".join(f"\t{t}=\r\n\t{{\r\n\t\tvalue={j}\r\n\t\tlevel=2\r\n\t\tinfluence_value=1.000\r\n\t}}\r\n" for j, t in enumerate(tags) if t != tag)
        army = "".join(f'\t\tregiment=\r\n\t\t{{\r\n\t\t\tid=\r\n\t\t\t{{\r\n\t\t\t\tid={j}\r\n\t\t\t\ttype=40\r\n\t\t\t}}\r\n\t\t\tname="Guard {j}"\r\n\t\t\tpop=\r\n\t\t\t{{\r\n\t\t\t\tid={i * regiments + j + 1}\r\n\t\t\t\ttype=46\r\n\t\t\t}}\r\n\t\t\tstrength=3.000\r\n\t\t\ttype=infantry\r\n\t\t}}\r\n' for j in range(regiments))
        techs = "".join(f"\t\ttech_{j}=\r\n\t\t{{\r\n\t\t\t{j % 2} {j % 2}.000\r\n\t\t}}\r\n" for j in range(60))
        out.append(
            f'{tag}=\r\n{{\r\n\tprimary_culture="cult{i % 17}"\r\n\tculture=\r\n\t{{\r\n\t\t"cult{(i + 1) % 17}"\r\n\t}}\r\n\tcivilized=yes\r\n\tprestige={i}.000\r\n\ttechnology=\r\n\t{{\r\n{techs}\t}}\r\n{relations}'
            f'\tarmy=\r\n\t{{\r\n\t\tname="Host"\r\n\t\tlocation={i + 1}\r\n{army}\t}}\r\n\tstate=\r\n\t{{\r\n\t\tprovinces=\r\n\t\t{{\r\n\t\t\t{i + 1} {i + 1 + countries}\r\n\t\t}}\r\n\t}}\r\n}}\r\n'
        )
    return "".join(out).encode("latin-1")
