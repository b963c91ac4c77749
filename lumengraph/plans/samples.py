"""Small files of every language and format, and the graph that each stands for, written out."""

from __future__ import annotations

#: name -> (path, source, nodes as "id | label | type", links as "source relation target context").
SAMPLES: dict[str, tuple[str, str, str, str]] = {
    'python': (
        'shop/cart.py',
        '''"""Everything about carts of the shop in one place."""
import os.path
from .items import Item, price as cost


class Cart(Base):
    """Holds the items until they are paid for."""

    def add(self, item: Item, notes: list[Note]) -> Receipt:
        return total(item)


# NOTE: rounding is done by the bank, not here
def total(item):
    return cost(item)
''',
        """
shop_cart | cart.py | code
shop_cart_cart | Cart | code
base | Base | code
shop_cart_cart_add | .add() | code
item | Item | code
note | Note | code
receipt | Receipt | code
shop_cart_total | total() | code
shop_cart_rationale_1 | Everything about carts of the shop in one place. | rationale
shop_cart_rationale_7 | Holds the items until they are paid for. | rationale
shop_cart_rationale_13 | # NOTE: rounding is done by the bank, not here | rationale
        """,
        """
shop_cart imports os_path import
shop_cart imports_from shop_items_py import
shop_cart contains shop_cart_cart -
shop_cart_cart inherits base -
shop_cart_cart method shop_cart_cart_add -
shop_cart_cart_add references item parameter_type
shop_cart_cart_add references note generic_arg
shop_cart_cart_add references receipt return_type
shop_cart contains shop_cart_total -
shop_cart_cart_add calls shop_cart_total call
shop_cart_rationale_1 rationale_for shop_cart -
shop_cart_rationale_7 rationale_for shop_cart_cart -
shop_cart_rationale_13 rationale_for shop_cart -
        """,
    ),
    'javascript': (
        'web/store.js',
        """import api, { load, save as keep } from './api';
import React from 'react';
export { helper } from './util';

export class Store extends Base {
  open() {
    return load(this.key);
  }
}

export function boot() {
  start();
}

const start = () => {
  boot();
};
""",
        """
web_store | store.js | code
web_store_store | Store | code
base | Base | code
web_store_store_open | .open() | code
web_store_boot | boot() | code
        """,
        """
web_store imports_from web_api import
web_store imports web_api_load import
web_store imports web_api_save import
web_store imports_from ref_react import
web_store re_exports web_util re-export
web_store contains web_store_store -
web_store_store inherits base -
web_store_store method web_store_store_open -
web_store contains web_store_boot -
        """,
    ),
    'typescript': (
        'web/app.ts',
        """import type { Config } from './config';

interface Shape extends Named {
  area(): number;
}

export class Circle extends Round implements Shape {
  private radius: Length;
  area(): number {
    return square(this.radius);
  }
}

function square(x: Length): Area {
  return x * x;
}
""",
        """
web_app | app.ts | code
web_app_shape | Shape | code
named | Named | code
web_app_circle | Circle | code
round | Round | code
web_app_circle_area | .area() | code
web_app_square | square() | code
        """,
        """
web_app imports_from web_config import
web_app imports web_config_config import
web_app contains web_app_shape -
web_app_shape inherits named -
web_app contains web_app_circle -
web_app_circle inherits round -
web_app_circle implements web_app_shape -
web_app_circle method web_app_circle_area -
web_app contains web_app_square -
web_app_circle_area calls web_app_square call
        """,
    ),
    'java': (
        'src/Order.java',
        """package shop;

import java.util.List;
import shop.items.*;

public class Order extends Record implements Payable {
    private Customer customer;
    private List<Item> items;

    public Receipt pay(Wallet wallet) {
        check(wallet);
        return null;
    }

    private void check(Wallet wallet) {
    }
}

enum State {
    OPEN, PAID
}
""",
        """
src_order | Order.java | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
customer | Customer | code
item | Item | code
src_order_order_pay | .pay() | code
wallet | Wallet | code
receipt | Receipt | code
src_order_order_check | .check() | code
src_order_state | State | code
src_order_state_open | OPEN | code
src_order_state_paid | PAID | code
        """,
        """
src_order imports list import
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements payable -
src_order_order references customer field
src_order_order references item generic_arg
src_order_order method src_order_order_pay -
src_order_order_pay references wallet parameter_type
src_order_order_pay references receipt return_type
src_order_order method src_order_order_check -
src_order_order_check references wallet parameter_type
src_order contains src_order_state -
src_order_state case_of src_order_state_open -
src_order_state case_of src_order_state_paid -
src_order_order_pay calls src_order_order_check call
        """,
    ),
    'c': (
        'src/list.c',
        """#include <stdio.h>
#include "node.h"

struct list { int n; };

static int grow(struct list *l) {
    return l->n;
}

int push(struct list *l, struct node *x) {
    return grow(l);
}
""",
        """
src_list | list.c | code
src_list_grow | grow() | code
list | list | code
src_list_push | push() | code
node | node | code
        """,
        """
src_list imports stdio import
src_list imports node import
src_list contains src_list_grow -
src_list_grow references list parameter_type
src_list contains src_list_push -
src_list_push references list parameter_type
src_list_push references node parameter_type
src_list_push calls src_list_grow call
        """,
    ),
    'cpp': (
        'src/shape.cpp',
        """#include "shape.h"

class Shape : public Base {
public:
    Area area(Unit u) { return scale(u); }
    Area scale(Unit u) { return Area(); }
private:
    Point origin;
};

void draw(Shape s) {
}
""",
        """
src_shape | shape.cpp | code
src_shape_shape | Shape | code
base | Base | code
point | Point | code
src_shape_shape_origin | origin | code
src_shape_shape_area | .area() | code
area | Area | code
unit | Unit | code
src_shape_shape_scale | .scale() | code
src_shape_draw | draw() | code
        """,
        """
src_shape imports shape import
src_shape contains src_shape_shape -
src_shape_shape inherits base -
src_shape_shape references point field
src_shape_shape defines src_shape_shape_origin field
src_shape_shape method src_shape_shape_area -
src_shape_shape_area references area return_type
src_shape_shape_area references unit parameter_type
src_shape_shape method src_shape_shape_scale -
src_shape_shape_scale references area return_type
src_shape_shape_scale references unit parameter_type
src_shape contains src_shape_draw -
src_shape_draw references src_shape_shape parameter_type
src_shape_shape_area calls src_shape_shape_scale call
src_shape_shape_scale calls area call
        """,
    ),
    'csharp': (
        'src/Order.cs',
        """using System.Text;

namespace Shop
{
    public class Order : Record, IPayable
    {
        private Customer customer;
        public Receipt Pay(Wallet wallet)
        {
            Check(wallet);
            return null;
        }
        private void Check(Wallet wallet) { }
    }
}
""",
        """
src_order | Order.cs | code
csharp_namespace:55de88709232ec03 | Shop | code
src_order_shop_order | Order | code
record | Record | code
ipayable | IPayable | code
customer | Customer | code
src_order_shop_order_pay | .Pay() | code
wallet | Wallet | code
receipt | Receipt | code
src_order_shop_order_check | .Check() | code
        """,
        """
src_order contains csharp_namespace:55de88709232ec03 -
src_order imports system_text import
src_order contains src_order_shop_order -
src_order_shop_order inherits record -
src_order_shop_order implements ipayable -
src_order_shop_order references customer field
src_order_shop_order method src_order_shop_order_pay -
src_order_shop_order_pay references wallet parameter_type
src_order_shop_order_pay references receipt return_type
src_order_shop_order method src_order_shop_order_check -
src_order_shop_order_check references wallet parameter_type
src_order_shop_order_pay calls src_order_shop_order_check call
        """,
    ),
    'php': (
        'src/Order.php',
        r"""<?php
namespace Shop;
use Shop\Items\Item;

class Order extends Record implements Payable {
    public function pay(Wallet $wallet): Receipt {
        return $this->check($wallet);
    }
    private function check(Wallet $wallet) {
        audit($wallet);
    }
}

function audit($x) {
}
""",
        """
src_order | Order.php | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
src_order_order_pay | .pay() | code
wallet | Wallet | code
receipt | Receipt | code
src_order_order_check | .check() | code
src_order_audit | audit() | code
        """,
        """
src_order imports item import
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements payable -
src_order_order method src_order_order_pay -
src_order_order_pay references wallet parameter_type
src_order_order_pay references receipt return_type
src_order_order method src_order_order_check -
src_order_order_check references wallet parameter_type
src_order contains src_order_audit -
src_order_order_pay calls src_order_order_check call
src_order_order_check calls src_order_audit call
        """,
    ),
    'swift': (
        'src/Order.swift',
        """import Foundation

protocol Payable {
    func pay()
}

class Order: Record, Payable {
    var customer: Customer
    func pay() {
        check()
    }
    func check() {
    }
}

enum State {
    case open, paid
}
""",
        """
src_order | Order.swift | code
foundation | Foundation | code
src_order_payable | Payable | code
src_order_order | Order | code
record | Record | code
customer | Customer | code
src_order_order_pay | .pay() | code
src_order_order_check | .check() | code
src_order_state | State | code
src_order_state_open | open | code
src_order_state_paid | paid | code
        """,
        """
src_order imports foundation import
src_order contains src_order_payable -
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements src_order_payable -
src_order_order references customer field
src_order_order method src_order_order_pay -
src_order_order method src_order_order_check -
src_order contains src_order_state -
src_order_state case_of src_order_state_open -
src_order_state case_of src_order_state_paid -
src_order_order_pay calls src_order_order_check call
        """,
    ),
    'ruby': (
        'src/order.rb',
        """class Order < Record
  def pay(wallet)
    check(wallet)
  end

  def check(wallet)
    audit(wallet)
  end
end

def audit(x)
  x
end
""",
        """
src_order | order.rb | code
src_order_order | Order | code
record | Record | code
src_order_order_pay | .pay() | code
src_order_order_check | .check() | code
src_order_audit | audit() | code
        """,
        """
src_order contains src_order_order -
src_order_order inherits record -
src_order_order method src_order_order_pay -
src_order_order method src_order_order_check -
src_order contains src_order_audit -
src_order_order_pay calls src_order_order_check call
src_order_order_check calls src_order_audit call
        """,
    ),
    'kotlin': (
        'src/Order.kt',
        """package shop

class Order(val customer: Customer) : Record(), Payable {
    fun pay(wallet: Wallet): Receipt {
        return check(wallet)
    }
    fun check(wallet: Wallet): Receipt {
        return Receipt()
    }
}

enum class State { OPEN, PAID }
""",
        """
src_order | Order.kt | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
src_order_order_pay | .pay() | code
wallet | Wallet | code
receipt | Receipt | code
src_order_order_check | .check() | code
src_order_state | State | code
src_order_state_open | OPEN | code
src_order_state_paid | PAID | code
        """,
        """
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements payable -
src_order_order method src_order_order_pay -
src_order_order_pay references wallet parameter_type
src_order_order_pay references receipt return_type
src_order_order method src_order_order_check -
src_order_order_check references wallet parameter_type
src_order_order_check references receipt return_type
src_order contains src_order_state -
src_order_state case_of src_order_state_open -
src_order_state case_of src_order_state_paid -
src_order_order_pay calls src_order_order_check call
src_order_order_check calls receipt call
        """,
    ),
    'scala': (
        'src/Order.scala',
        """import scala.io.Source

trait Payable {
  def pay(w: Wallet): Receipt
}

class Order(c: Customer) extends Record with Payable {
  def pay(w: Wallet): Receipt = {
    check(w)
  }
  def check(w: Wallet): Receipt = {
    new Receipt()
  }
}
""",
        """
src_order | Order.scala | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
customer | Customer | code
src_order_order_pay | .pay() | code
wallet | Wallet | code
receipt | Receipt | code
src_order_order_check | .check() | code
        """,
        """
src_order imports scala import
src_order contains src_order_order -
src_order_order inherits record -
src_order_order mixes_in payable -
src_order_order references customer field
src_order_order method src_order_order_pay -
src_order_order_pay references wallet parameter_type
src_order_order_pay references receipt return_type
src_order_order method src_order_order_check -
src_order_order_check references wallet parameter_type
src_order_order_check references receipt return_type
src_order_order_pay calls src_order_order_check call
        """,
    ),
    'lua': (
        'src/order.lua',
        """local items = require('shop.items')

function check(wallet)
  return wallet
end

function Order.pay(wallet)
  return check(wallet)
end

local function audit()
  check(1)
end
""",
        """
src_order | order.lua | code
src_order_check | check() | code
src_order_order_pay | Order.pay() | code
src_order_audit | audit() | code
        """,
        """
src_order imports shop_items import
src_order contains src_order_check -
src_order contains src_order_order_pay -
src_order contains src_order_audit -
src_order_order_pay calls src_order_check call
src_order_audit calls src_order_check call
        """,
    ),
    'groovy': (
        'src/Order.groovy',
        """import shop.items.Item

class Order extends Record implements Payable {
    def pay(wallet) {
        check(wallet)
    }
    def check(wallet) {
    }
}
""",
        """
src_order | Order.groovy | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
src_order_order_pay | .pay() | code
src_order_order_check | .check() | code
        """,
        """
src_order imports item import
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements payable -
src_order_order method src_order_order_pay -
src_order_order method src_order_order_check -
src_order_order_pay calls src_order_order_check call
        """,
    ),
    'go': (
        'shop/cart.go',
        """package shop

import (
    "fmt"
    "shop/items"
)

type Payable interface {
    Named
    Pay() error
}

type Order struct {
    Record
    items []Item
}

func (o *Order) Pay() error {
    return check(o)
}

func check(o *Order) error {
    fmt.Println(o)
    return nil
}
""",
        """
shop_cart | cart.go | code
shop_payable | Payable | code
shop_order | Order | code
shop_order_pay | .Pay() | code
shop_cart_check | check() | code
        """,
        """
shop_cart imports_from go_pkg_fmt import
shop_cart imports_from go_pkg_shop_items import
shop_cart contains shop_payable -
shop_cart contains shop_order -
shop_order method shop_order_pay -
shop_cart contains shop_cart_check -
shop_cart_check references shop_order parameter_type
shop_order_pay calls shop_cart_check call
        """,
    ),
    'rust': (
        'src/order.rs',
        """use std::collections::HashMap;

pub trait Payable: Named {
    fn pay(&self) -> Receipt;
}

pub struct Order {
    items: Vec<Item>,
}

impl Payable for Order {
    fn pay(&self) -> Receipt {
        check(self)
    }
}

fn check(o: &Order) -> Receipt {
    Receipt {}
}
""",
        """
src_order | order.rs | code
src_order_payable | Payable | code
named | Named | code
src_order_order | Order | code
vec | Vec | code
item | Item | code
src_order_order_pay | .pay() | code
receipt | Receipt | code
src_order_check | check() | code
        """,
        """
src_order imports_from hashmap import
src_order contains src_order_payable -
src_order_payable inherits named -
src_order contains src_order_order -
src_order_order references vec field
src_order_order references item generic_arg
src_order_order implements src_order_payable -
src_order_order method src_order_order_pay -
src_order_order_pay references receipt return_type
src_order contains src_order_check -
src_order_check references src_order_order parameter_type
src_order_check references receipt return_type
src_order_order_pay calls src_order_check call
        """,
    ),
    'bash': (
        'bin/run.sh',
        """#!/bin/bash
source ./lib.sh
export HOME_DIR=/srv

setup() {
  prepare
}

prepare() {
  echo ready
}

setup
./other.sh
""",
        """
bin_run | run.sh | code
bin_run_sh__entry | run.sh script | code
bin_run_home_dir | HOME_DIR | code
bin_run_setup | setup() | code
bin_run_prepare | prepare() | code
        """,
        """
bin_run contains bin_run_sh__entry -
bin_run defines bin_run_home_dir -
bin_run defines bin_run_setup -
bin_run defines bin_run_prepare -
bin_run_sh__entry calls bin_run_setup call
bin_run_setup calls bin_run_prepare call
        """,
    ),
    'elixir': (
        'lib/order.ex',
        """defmodule Shop.Order do
  alias Shop.Item
  import Ecto.Query

  def pay(wallet) do
    check(wallet)
  end

  defp check(wallet), do: wallet
end
""",
        """
lib_order | order.ex | code
lib_order_shop_order | Shop.Order | code
lib_order_shop_order_pay | pay() | code
lib_order_shop_order_check | check() | code
        """,
        """
lib_order contains lib_order_shop_order -
lib_order imports shop_item import
lib_order imports ecto_query import
lib_order_shop_order method lib_order_shop_order_pay -
lib_order_shop_order method lib_order_shop_order_check -
lib_order_shop_order_pay calls lib_order_shop_order_check call
        """,
    ),
    'zig': (
        'src/order.zig',
        """const std = @import("std");
const items = @import("items.zig");

const Order = struct {
    total: u32,

    pub fn pay(self: Order) u32 {
        return check(self.total);
    }
};

fn check(x: u32) u32 {
    return x;
}
""",
        """
src_order | order.zig | code
src_order_order | Order | code
src_order_order_pay | .pay() | code
src_order_check | check() | code
        """,
        """
src_order imports_from std -
src_order imports_from items -
src_order contains src_order_order -
src_order_order method src_order_order_pay -
src_order contains src_order_check -
src_order_order_pay calls src_order_check -
        """,
    ),
    'powershell': (
        'src/order.ps1',
        """using module Shop.Items
. ./lib/audit.ps1

class Order : Record, IPayable {
    [Customer]$Customer
    [Receipt] Pay([Wallet]$wallet) {
        return $null
    }
}

function Get-Total {
    Get-Tax
}

function Get-Tax {
    Import-Module Shop.Tax
}
""",
        """
src_order | order.ps1 | code
src_order_order | Order | code
record | Record | code
ipayable | IPayable | code
customer | Customer | code
src_order_order_pay | .Pay() | code
receipt | Receipt | code
wallet | Wallet | code
src_order_get_total | Get-Total() | code
src_order_get_tax | Get-Tax() | code
        """,
        """
src_order imports_from items -
src_order imports_from audit -
src_order imports_from tax -
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements ipayable -
src_order_order references customer field
src_order_order method src_order_order_pay -
src_order_order_pay references receipt return_type
src_order_order_pay references wallet parameter_type
src_order contains src_order_get_total -
src_order contains src_order_get_tax -
src_order_get_total calls src_order_get_tax -
        """,
    ),
    'objc': (
        'src/Order.m',
        """#import "Order.h"
#import <Foundation/Foundation.h>

@interface Order : Record <Payable>
@property (nonatomic) Customer *customer;
- (void)pay;
@end

@implementation Order
- (void)pay {
    [self check];
}
- (void)check {
}
@end
""",
        """
src_order | Order.m | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
customer | Customer | code
src_order_order_pay | -pay | code
src_order_order_check | -check | code
        """,
        """
src_order imports order import
src_order imports foundation import
src_order contains src_order_order -
src_order_order inherits record -
src_order_order implements payable -
src_order_order references customer field
src_order_order method src_order_order_pay -
src_order_order method src_order_order_check -
src_order_order_pay calls src_order_order_check call
        """,
    ),
    'julia': (
        'src/Order.jl',
        """module Shop

using Items
import Base

abstract type Payable end

struct Order <: Payable
    total::Money
end

function pay(o::Order)
    check(o)
end

check(o) = o

end
""",
        """
src_order | Order.jl | code
src_order_shop | Shop | code
items | Items | code
base | Base | code
src_order_payable | Payable | code
src_order_order | Order | code
money | Money | code
src_order_pay | pay() | code
src_order_check | check() | code
        """,
        """
src_order defines src_order_shop -
src_order_shop imports items import
src_order_shop imports base import
src_order_shop defines src_order_payable -
src_order_shop defines src_order_order -
src_order_order inherits src_order_payable -
src_order_order references money field
src_order_shop defines src_order_pay -
src_order_shop defines src_order_check -
src_order_pay calls src_order_check call
        """,
    ),
    'fortran': (
        'src/order.f90',
        """module shop
  use items
  implicit none
contains
  subroutine Pay(total)
    integer :: total
    call Check(total)
  end subroutine Pay
  subroutine Check(total)
    integer :: total
  end subroutine Check
end module shop
""",
        """
src_order | order.f90 | code
src_order_shop | shop | code
items | items | code
src_order_pay | pay() | code
src_order_check | check() | code
        """,
        """
src_order defines src_order_shop -
src_order_shop imports items use
src_order_shop defines src_order_pay -
src_order_shop defines src_order_check -
src_order_pay calls src_order_check call
        """,
    ),
    'dart': (
        'lib/order.dart',
        """import 'package:shop/items.dart';
export 'src/state.dart';

mixin Logging {
  void log() {}
}

class Order extends Record with Logging implements Payable {
  final Customer customer;
  void pay() {
    check();
  }
}

void check() {}
""",
        """
lib_order | order.dart | code
lib_order_logging | Logging | code
lib_order_order | Order | code
record | Record | code
payable | Payable | code
lib_order_customer | customer | code
lib_order_log | log | code
lib_order_pay | pay | code
lib_order_check | check | code
package_shop_items_dart | package:shop/items.dart | code
src_state_dart | src/state.dart | code
        """,
        """
lib_order defines lib_order_logging -
lib_order defines lib_order_order -
lib_order_order inherits record -
lib_order_order mixes_in lib_order_logging -
lib_order_order implements payable -
lib_order defines lib_order_customer -
lib_order defines lib_order_log -
lib_order defines lib_order_pay -
lib_order defines lib_order_check -
lib_order imports package_shop_items_dart -
lib_order exports src_state_dart -
        """,
    ),
    'sql': (
        'db/shop.sql',
        """CREATE TABLE customer (id int primary key);
CREATE TABLE orders (
  id int,
  customer_id int REFERENCES customer(id)
);
CREATE VIEW open_orders AS SELECT * FROM orders JOIN customer ON true;
CREATE FUNCTION total() RETURNS int AS $$ SELECT 1 $$ LANGUAGE sql;
""",
        """
db_shop | shop.sql | code
db_shop_customer | customer | code
db_shop_orders | orders | code
db_shop_open_orders | open_orders | code
db_shop_total | total() | code
        """,
        """
db_shop contains db_shop_customer -
db_shop contains db_shop_orders -
db_shop_orders references db_shop_customer -
db_shop contains db_shop_open_orders -
db_shop_open_orders reads_from db_shop_orders -
db_shop_open_orders reads_from db_shop_customer -
db_shop contains db_shop_total -
        """,
    ),
    'terraform': (
        'infra/main.tf',
        """variable "region" {}

locals {
  name = var.region
}

module "net" {
  source = "./net"
}

resource "aws_instance" "web" {
  tags       = local.name
  depends_on = [module.net]
}

output "ip" {
  value = aws_instance.web.ip
}
""",
        """
infra_main | main.tf | code
infra_var_region | var.region | code
infra_local_name | local.name | code
infra_module_net | module.net | code
infra_aws_instance_web | aws_instance.web | code
infra_output_ip | output.ip | code
        """,
        """
infra_main contains infra_var_region -
infra_main contains infra_local_name -
infra_main contains infra_module_net -
infra_main contains infra_aws_instance_web -
infra_main contains infra_output_ip -
infra_local_name references infra_var_region -
infra_aws_instance_web references infra_local_name -
infra_aws_instance_web depends_on infra_module_net -
infra_output_ip references infra_aws_instance_web -
        """,
    ),
    'verilog': (
        'rtl/top.v',
        """module adder(input a, input b, output c);
  assign c = a ^ b;
endmodule

module top(input x, input y, output z);
  adder u1(.a(x), .b(y), .c(z));
  function parity(input p);
    parity = p;
  endfunction
  task reset;
  endtask
endmodule
""",
        """
rtl_top | top.v | code
rtl_top_adder | adder | code
rtl_top_top | top | code
rtl_top_top_parity | parity() | code
rtl_top_top_reset | reset | code
adder | adder | code
        """,
        """
rtl_top defines rtl_top_adder -
rtl_top defines rtl_top_top -
rtl_top_top contains rtl_top_top_parity -
rtl_top_top contains rtl_top_top_reset -
rtl_top_top instantiates adder -
        """,
    ),
    'pascal': (
        'src/Order.pas',
        """unit Order;

interface

uses Items, Money;

type
  TOrder = class(TRecord)
    procedure Pay;
    procedure Check;
  end;

implementation

procedure TOrder.Pay;
begin
  Check;
end;

procedure TOrder.Check;
begin
end;

end.
""",
        """
src_order | Order.pas | code
src_order_order | Order | code
src_order_torder | TOrder | code
trecord | TRecord | code
src_order_torder_pay | Pay() | code
src_order_torder_check | Check() | code
        """,
        """
src_order contains src_order_order -
src_order_order imports items import
src_order_order imports money import
src_order_order contains src_order_torder -
src_order_torder inherits trecord -
src_order_torder method src_order_torder_pay -
src_order_torder method src_order_torder_check -
src_order_torder_pay calls src_order_torder_check call
        """,
    ),
    'pascal_form': (
        'src/Main.dfm',
        """object Form1: TForm1
  Caption = 'Shop'
  object Button1: TButton
    OnClick = Button1Click
  end
end
""",
        """
src_main | Main.dfm | code
src_main_tform1 | TForm1 | code
src_main_tbutton | TButton | code
src_main_button1click | Button1Click() | code
        """,
        """
src_main contains src_main_tform1 -
src_main_tform1 contains src_main_tbutton -
src_main_tbutton references src_main_button1click event
        """,
    ),
    'pascal_package': (
        'src/shop.lpk',
        """<?xml version="1.0"?>
<CONFIG>
  <Package Version="4">
    <Name Value="shop"/>
    <Files Count="1">
      <Item1>
        <Filename Value="order.pas"/>
        <UnitName Value="Order"/>
      </Item1>
    </Files>
    <RequiredPkgs Count="1">
      <Item1>
        <PackageName Value="LCL"/>
      </Item1>
    </RequiredPkgs>
  </Package>
</CONFIG>
""",
        """
src_shop | shop.lpk | code
src_shop_shop | shop | code
lcl | LCL | code
order | Order | code
        """,
        """
src_shop contains src_shop_shop -
src_shop_shop imports lcl import
src_shop_shop contains order -
        """,
    ),
    'vue': (
        'web/Cart.vue',
        """<template>
  <Item/>
</template>
<script>
import Item from './Item.vue'
function load() {
  show()
}
function show() {}
const Lazy = () => import('./Lazy.vue')
</script>
""",
        """
web_cart | Cart.vue | code
web_cart_load | load() | code
web_cart_show | show() | code
web_lazy_vue | ./Lazy.vue | code
        """,
        """
web_cart imports_from web_item_vue import
web_cart contains web_cart_load -
web_cart contains web_cart_show -
web_cart_load calls web_cart_show call
web_cart dynamic_import web_lazy_vue -
        """,
    ),
    'svelte': (
        'web/Cart.svelte',
        """<script>
  import Item from './Item.svelte';
  function load() {
    show();
  }
  function show() {}
</script>
<Item/>
""",
        """
web_cart | Cart.svelte | code
web_item_svelte | ./Item.svelte | code
        """,
        """
web_cart imports_from web_item_svelte -
        """,
    ),
    'astro': (
        'web/Page.astro',
        """---
import Layout from './Layout.astro';
function title() {
  return name();
}
function name() {}
---
<Layout/>
""",
        """
web_page | Page.astro | code
web_page_title | title() | code
web_page_name | name() | code
web_layout_astro | ./Layout.astro | code
        """,
        """
web_page contains web_page_title -
web_page contains web_page_name -
web_page_title calls web_page_name call
web_page imports_from web_layout_astro -
        """,
    ),
    'razor': (
        'web/Cart.razor',
        """@page "/cart"
@using Shop.Items
@inject CartService Carts
@inherits ShopPage

<ItemList />

@code {
    private void Load()
    {
    }
}
""",
        """
web_cart | Cart.razor | code
route_cart | route:/cart | concept
shop_items | Shop.Items | code
cartservice | CartService | code
shoppage | ShopPage | code
itemlist | ItemList | code
web_cart_load | Load | code
        """,
        """
web_cart references route_cart -
web_cart imports shop_items -
web_cart imports cartservice -
web_cart inherits shoppage -
web_cart calls itemlist -
web_cart contains web_cart_load -
        """,
    ),
    'blade': (
        'views/cart.blade.php',
        """@extends('layouts.shop')
@include('cart.items')
<x-alert type="info"/>
<livewire:cart-total/>
<button wire:click="checkout">Pay</button>
""",
        """
views_cart_blade | cart.blade.php | code
cart_items | cart.items | code
cart_total | cart-total | code
checkout | checkout | code
        """,
        """
views_cart_blade includes cart_items -
views_cart_blade uses_component cart_total -
views_cart_blade binds_method checkout -
        """,
    ),
    'xaml': (
        'views/Cart.xaml',
        """<Window x:Class="Shop.Cart" xmlns="http://schemas.microsoft.com/winfx/2006/xaml/presentation" xmlns:x="http://schemas.microsoft.com/winfx/2006/xaml">
  <Grid x:Name="root">
    <Button x:Name="pay" Content="{Binding Total}" Command="{Binding PayCommand}" Click="OnPay"/>
  </Grid>
</Window>
""",
        """
views_cart | Cart.xaml | code
views_cart_window | Window | code
views_cart_cart | Cart | code
views_cart_root | root | code
xaml_grid | Grid | concept
views_cart_pay | pay | code
xaml_button | Button | concept
binding_total | Total | concept
binding_paycommand | PayCommand | concept
        """,
        """
views_cart contains views_cart_window -
views_cart_window references views_cart_cart x_class
views_cart_window contains views_cart_root -
views_cart_root references xaml_grid type
views_cart_window contains views_cart_pay -
views_cart_pay references xaml_button type
views_cart_pay references binding_total binding_path
views_cart_pay references binding_paycommand binding_command
        """,
    ),
    'csproj': (
        'src/Shop.csproj',
        """<Project Sdk="Microsoft.NET.Sdk">
  <PropertyGroup>
    <TargetFramework>net8.0</TargetFramework>
  </PropertyGroup>
  <ItemGroup>
    <PackageReference Include="Serilog" Version="3.0"/>
    <ProjectReference Include="../Items/Items.csproj"/>
  </ItemGroup>
</Project>
""",
        """
src_shop | Shop.csproj | code
framework_net8_0 | net8.0 | concept
nuget_serilog | Serilog (3.0) | concept
items_items_csproj | Items.csproj | code
sdk_microsoft_net_sdk | Microsoft.NET.Sdk | concept
        """,
        """
src_shop references framework_net8_0 -
src_shop imports nuget_serilog -
src_shop imports items_items_csproj -
src_shop references sdk_microsoft_net_sdk -
        """,
    ),
    'sln': (
        'Shop.sln',
        """Microsoft Visual Studio Solution File, Format Version 12.00
Project("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "Shop", "src/Shop.csproj", "{11111111-1111-1111-1111-111111111111}"
EndProject
Project("{FAE04EC0-301F-11D3-BF4B-00C04F79EFBC}") = "Items", "Items/Items.csproj", "{22222222-2222-2222-2222-222222222222}"
EndProject
""",
        """
shop | Shop.sln | code
src_shop_csproj | Shop | code
items_items_csproj | Items | code
        """,
        """
shop contains src_shop_csproj -
shop contains items_items_csproj -
        """,
    ),
    'mcp_config': (
        '.mcp.json',
        """{"mcpServers": {"files": {"command": "npx", "args": ["-y", "@scope/server-files@1.2"], "env": {"API_KEY": "x"}}}}""",
        """
mcp | .mcp.json | code
mcp_mcp_server_files | files | code
mcp_command_npx | npx | code
mcp_package_scope_server_files | @scope/server-files | code
env_var_api_key | API_KEY | code
        """,
        """
mcp contains mcp_mcp_server_files -
mcp_mcp_server_files references mcp_command_npx command
mcp_mcp_server_files references mcp_package_scope_server_files package
mcp_mcp_server_files requires_env env_var_api_key -
        """,
    ),
    'json_manifest': (
        'web/package.json',
        """{"name": "shop", "dependencies": {"react": "18"}, "scripts": {"build": "make"}}""",
        """
web_package | package.json | code
web_package_name | name | code
web_package_dependencies | dependencies | code
web_package_dependencies_react | react | code
react | react | concept
web_package_scripts | scripts | code
web_package_scripts_build | build | code
        """,
        """
web_package contains web_package_name -
web_package contains web_package_dependencies -
web_package_dependencies contains web_package_dependencies_react -
web_package_dependencies_react imports react import
web_package contains web_package_scripts -
web_package_scripts contains web_package_scripts_build -
        """,
    ),
    'apex': (
        'src/Order.cls',
        """public with sharing class Order extends Record implements Payable {
    @AuraEnabled
    public static void pay(Id x) {
        List<Account> a = [SELECT Id FROM Account];
        insert a;
    }
}
""",
        """
src_order | Order.cls | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
src_order_order_pay | .pay() | code
account | Account | code
dml_insert | insert | code
        """,
        """
src_order contains src_order_order -
src_order_order extends record -
src_order_order implements payable -
src_order_order method src_order_order_pay -
src_order contains src_order_order_pay -
src_order_order uses account -
src_order_order uses dml_insert -
        """,
    ),
    'r': (
        'src/order.R',
        """library(dplyr)
source('items.R')

pay <- function(x) {
  check(x)
}

check <- function(x) x
""",
        """
src_order | order.R | code
src_order_pay | pay() | code
src_order_check | check() | code
        """,
        """
src_order imports dplyr import
src_order imports items_r import
src_order contains src_order_pay -
src_order contains src_order_check -
src_order_pay calls src_order_check call
        """,
    ),
    'nix': (
        'pkgs/shop.nix',
        """{ pkgs, lib }:
let
  helper = x: x;
  items = import ./items.nix;
in {
  total = helper 1;
}
""",
        """
pkgs_shop | shop.nix | code
pkgs_shop_helper | helper() | code
        """,
        """
pkgs_shop imports items import
pkgs_shop contains pkgs_shop_helper -
        """,
    ),
    'solidity': (
        'src/Order.sol',
        """import "./Items.sol";

contract Order is Record, Payable {
    function pay() public {
        check();
    }
    function check() internal {
    }
}
""",
        """
src_order | Order.sol | code
src_order_order | Order | code
record | Record | code
payable | Payable | code
src_order_pay | pay() | code
src_order_check | check() | code
        """,
        """
src_order imports items import
src_order contains src_order_order -
src_order_order inherits record -
src_order_order inherits payable -
src_order contains src_order_pay -
src_order contains src_order_check -
src_order_pay calls src_order_check call
        """,
    ),
    'ada': (
        'src/order.adb',
        """with Ada.Text_IO;
package body Order is
   procedure Check is
   begin
      null;
   end Check;
   procedure Pay is
   begin
      Check;
   end Pay;
end Order;
""",
        """
src_order | order.adb | code
src_order_order | Order | code
src_order_check | Check() | code
src_order_pay | Pay() | code
        """,
        """
src_order imports ada_text_io import
src_order contains src_order_order -
src_order contains src_order_check -
src_order contains src_order_pay -
src_order_pay calls src_order_check call
        """,
    ),
}

#: Files of one folder that name each other: path -> source.
FOLDER = {
    "web/main.ts": "import { draw as paint } from './lib';\nimport { Size } from './size.js';\nimport './lost';\n\nfunction go() {\n  paint();\n}\n",
    "web/lib/index.ts": "export function draw() {\n}\n",
    "web/size.ts": "export class Size {\n}\n",
    "web/Cart.vue": "<script>\nconst Lazy = () => import('./Lazy.vue')\n</script>\n",
    "web/Lazy.vue": "<script>\nfunction show() {}\n</script>\n",
    "bin/run.sh": "source ./lib.sh\nsource ./lost.sh\n./other.sh\n",
    "bin/lib.sh": "helper() {\n  echo\n}\n",
    "bin/other.sh": "echo\n",
    "game/app/main.lua": "local items = require('shop.items')\nlocal lost = require('lost')\n",
    "game/shop/items.lua": "function price()\n  return 1\nend\n",
}
#: Links between the files of the folder: relative imports reach the file that is there, else the id of the path as written.
FOLDER_LINKS = """
web_main imports_from web_lib_index import
web_main imports web_lib_index_draw import
web_main imports_from web_size import
web_main imports web_size_size import
web_main imports_from web_lost import
web_cart dynamic_import web_lazy -
bin_run imports_from bin_lib import
bin_run_sh__entry calls bin_other_sh__entry script_invocation
game_app_main imports game_shop_items import
game_app_main imports lost import
"""
