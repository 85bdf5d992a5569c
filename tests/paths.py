"""Folders of the driver's tables. A module of its own: ``conftest`` names one file per test folder."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
