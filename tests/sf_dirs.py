"""Folders of the test tables; a plain module, since the folders' conftest modules share one name."""

SF_SMALL = "/root/testdata/sf0.001"
