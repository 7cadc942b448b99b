from __future__ import annotations

import pytest

from palisade.operators.databases import DatabaseError, target

REF = "abcdefghijklmnopqrst"


@pytest.mark.parametrize(
    ("address", "host", "port"),
    [
        (f"postgres://u:p@db.{REF}.supabase.co/postgres", f"db.{REF}.supabase.co", 5432),
        (f"postgresql://u:p@DB.{REF}.supabase.co:6543/x?sslmode=require", f"db.{REF}.supabase.co", 6543),
        (f"postgres://postgres.{REF}:p@aws-0-eu-west-1.pooler.supabase.com:6543/x", "aws-0-eu-west-1.pooler.supabase.com", 6543),
    ],
)
def test_good(address, host, port):
    found = target(address, f"https://{REF}.supabase.co/")
    assert (found.host, found.port, found.project_ref, found.project_url) == (host, port, REF, f"https://{REF}.supabase.co")
    assert "u:p" not in repr(found)


@pytest.mark.parametrize(
    "address",
    [
        "no address", f"mysql://u@db.{REF}.supabase.co/x", f"postgres://u@db.{REF}.supabase.co/x#f", f"postgres://u@db.{REF}.supabase.co/x?host=h", f"postgres://u@db.{REF}.supabase.co/x?port=1", f"postgres://u@db.{REF}.supabase.co/x?sslmode=disable",
        f"postgres://u@db.{REF}.supabase.co:5433/x", "postgres:///x", f"postgres://u@db.{REF}.example.com/x", "postgres://u@db.A_b.supabase.co/x", "postgres://u@x.pooler.supabase.com/x", "postgres://u.A_@x.pooler.supabase.com/x",
        f"postgres://u.{REF}@pooler.supabase.com/x", "postgres://u@localhost/x", f"postgres://u@db.{REF}.supabase.co:99999/x",
    ],
)
def test_bad(address):
    with pytest.raises(DatabaseError) as e:
        target(address)
    assert "u@" not in str(e.value)


def test_other_project():
    with pytest.raises(DatabaseError):
        target(f"postgres://u@db.{REF}.supabase.co/x", "https://other.supabase.co")
    with pytest.raises(DatabaseError):
        target(f"postgres://u@db.{REF}.supabase.co/x", "https://example.com")
